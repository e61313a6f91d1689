"""Stored chat messages, links in answers, and picks out of a model's replies."""

from __future__ import annotations

import functools
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmesh.functions.text import trimmed

#: Messages and signals that are kept.
MOST_MESSAGES, MOST_SIGNALS = 50, 8
_SCHEMA = "array<struct<id:string,role:string,content:string,citations:array<struct<filePath:string,startLine:double,endLine:double,score:double,chunkCount:double>>,ui:struct<sourcesExpanded:boolean>,safety:struct<blocked:boolean,reason:string,signals:array<string>>>>"
_SESSIONS = "array<struct<chat_id:string,title:string,updatedAt:double,messages:string>>"


def _messages(payload: Column) -> Column:
    """The good messages of a JSON array: the last ones, with clean citations, signals and settings."""
    parsed = F.coalesce(F.from_json(payload, _SCHEMA, {"mode": "PERMISSIVE"}), F.array().cast(_SCHEMA))
    whole = lambda c: F.greatest(F.lit(1), F.floor(c)).cast("int")
    cited = lambda m: F.transform(
        F.filter(m["citations"], lambda c: (F.coalesce(c["filePath"], F.lit("")) != "") & c["startLine"].isNotNull() & c["endLine"].isNotNull() & c["score"].isNotNull() & c["chunkCount"].isNotNull()),
        lambda c: F.struct(c["filePath"].alias("filePath"), whole(c["startLine"]).alias("startLine"), whole(c["endLine"]).alias("endLine"), c["score"].alias("score"), whole(c["chunkCount"]).alias("chunkCount")),
    )
    good = F.filter(parsed, lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())
    made = F.transform(good, lambda m, i: F.struct(
        F.when(F.trim(F.coalesce(m["id"], F.lit(""))) != "", m["id"]).otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("id"), m["role"].alias("role"), m["content"].alias("content"), cited(m).alias("citations"),
        m["ui"]["sourcesExpanded"].alias("sources_expanded"), m["safety"]["blocked"].alias("blocked"), F.nullif(m["safety"]["reason"], F.lit("")).alias("reason"), F.slice(F.filter(m["safety"]["signals"], lambda s: s != ""), 1, MOST_SIGNALS).alias("signals")))
    return F.slice(made, F.greatest(F.lit(1), F.size(made) - MOST_MESSAGES + 1), MOST_MESSAGES)


def normalized(chats: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, messages`` out of stored JSON: messages without a known role or a text are dropped, as are citations with a
    part missing; line numbers and counts are whole and 1 at least, empty signals and reasons go, and the last messages
    are kept. A payload that isn't JSON has no messages; an object that wraps an array of messages counts as that array."""
    inner = F.coalesce(F.get_json_object(payload, "$.messages"), F.col(payload))
    return chats.select(key, _messages(inner).alias("messages"))


def title_of(messages: Column, fallback: Column, most: int = 40) -> Column:
    """The first question of the messages that isn't blank, white space folded and cut."""
    asked = F.get(F.filter(messages, lambda m: (m["role"] == "user") & (trimmed(m["content"]) != "")), F.lit(0))["content"]
    compact = F.regexp_replace(trimmed(asked), r"[ \t\n\r\f\x0b]+", " ")
    return F.when(asked.isNull(), fallback).when(F.length(compact) > most, F.concat(F.substring(compact, 1, most), F.lit("..."))).otherwise(compact)


def sessions(chats: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, chat_id, place, title, updated_at, messages, active``: the chats of a stored state, with that of an older form brought to the present one.

    The older form is an array of messages, which becomes one chat, ``legacy``.
    Sessions without a ``chat_id`` are dropped; one without a title is named by
    its first question, or by its place. The active chat is the one that the
    state names, else the first. A state that can't be read, or has no session,
    is one empty chat, ``fresh``.
    """
    raw = F.col(payload)
    is_array = F.coalesce(F.startswith(F.ltrim(raw), F.lit("[")), F.lit(False))
    old = F.array(F.struct(F.lit("legacy").alias("chat_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("updatedAt"), raw.alias("messages")))
    new = F.filter(F.coalesce(F.from_json(F.get_json_object(raw, "$.sessions"), _SESSIONS), F.array().cast(_SESSIONS)), lambda s: s["chat_id"].isNotNull())
    fresh = F.array(F.struct(F.lit("fresh").alias("chat_id"), F.lit("Chat 1").alias("title"), F.lit(None).cast("double").alias("updatedAt"), F.lit("[]").alias("messages")))
    readable = F.size(F.coalesce(F.from_json(raw, _SCHEMA), F.array().cast(_SCHEMA))) > 0
    state = F.when(is_array & readable, old).when(~is_array & (F.size(new) > 0), new).otherwise(fresh)
    rows = chats.select(key, F.get_json_object(raw, "$.activeChatId").alias("__active"), state.alias("__state"))
    known = F.exists("__state", lambda s: s["chat_id"] == F.col("__active"))
    first = F.when(F.coalesce(known, F.lit(False)), F.col("__active")).otherwise(F.col("__state")[0]["chat_id"])
    each = rows.select(key, first.alias("__chosen"), F.posexplode("__state").alias("place", "s"))
    each = each.select(key, "place", "__chosen", "s", _messages(F.col("s.messages")).alias("messages"))
    title = F.coalesce(F.col("s.title"), title_of(F.col("messages"), F.concat(F.lit("Chat "), (F.col("place") + 1).cast("string"))))
    return each.select(key, F.col("s.chat_id").alias("chat_id"), "place", title.alias("title"), F.col("s.updatedAt").alias("updated_at"), "messages", (F.col("s.chat_id") == F.col("__chosen")).alias("active"))


@functools.lru_cache(maxsize=256)
def _names(paths: tuple[str, ...]) -> re.Pattern:
    """Any of the paths, the longest first, with or without ticks; rows of one repository share it."""
    names = "|".join(re.escape(p) for p in sorted(set(paths), key=len, reverse=True))
    return re.compile(f"(`?)({names})(`?)")


_KEPT = re.compile(r"```[\s\S]*?```|\[[^\]]*\]\([^)]*\)")


def linked(text: str, paths: list[str], owner: str, repo: str, ref: str) -> str:
    """A text with links for the paths it names, the longest first, outside code blocks and links."""
    if not (text and paths and owner and repo and ref):
        return text
    found = _names(tuple(paths))

    def link(m):
        tick = "`" if m[1] and m[3] else ""
        address = "/".join(quote(s, safe="!'()*-._~") for s in m[2].split("/"))
        before, after = ("", "") if tick else (m[1], m[3])
        return f"{before}[{tick}{m[2]}{tick}](https://github.com/{owner}/{repo}/blob/{ref}/{address}){after}"

    out, at = [], 0
    for kept in _KEPT.finditer(text):
        out += [found.sub(link, text[at : kept.start()]), kept[0]]
        at = kept.end()
    return "".join([*out, found.sub(link, text[at:])])


@F.pandas_udf(StringType())
def with_links(text: pd.Series, paths: pd.Series, owner: pd.Series, repo: pd.Series, ref: pd.Series) -> pd.Series:
    """``linked`` as a column function."""
    return pd.Series([linked(t, list(p) if p is not None else [], o, r, c) for t, p, o, r, c in zip(text, paths, owner, repo, ref)])


def picked(reply: Column, shown: Column, most: int) -> Column:
    """What a model picks of the items it was shown: a JSON array, or any quoted strings; without a match the first ones."""
    array = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\[.*\])", 1), "array<string>")
    quoted = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit('"([^"]+)"'), F.lit(1))
    chosen = F.array_intersect(F.coalesce(array, quoted), shown)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(shown, 1, most))
