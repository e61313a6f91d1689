"""Conversations: windows, follow-ups, history for a model's prompt, titles and flags.

Turns are rows ``conv_id, turn, role, text``; the order of turns is ``turn``.
Everything is grouped by the conversation, which is bounded by what one chat holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ascii_word, retrieval_terms, trimmed
from quillmesh.functions.words import EXPANSION_STOP

#: Turns of history for hosted models and for local ones.
HISTORY = {"gemini": 10, "groq": 10, "mlc": 6}
SEPARATOR = "\n\n---\n\n"


def is_follow_up(query: Column) -> Column:
    """At most two words that carry signal."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*EXPANSION_STOP))) <= 2


def last_user_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, at, message``: the last turn of a user in each conversation."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("at"), F.max_by("text", "turn").alias("message"))


def contextual_queries(turns: DataFrame) -> DataFrame:
    """``conv_id, query``: the last question, and for a follow-up the terms of the last turns before it."""
    last = last_user_turns(turns)
    prior = turns.join(last, "conv_id").where("turn < at")
    said = prior.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("user"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("model"))
    rows = last.join(said, "conv_id", "left")
    none = F.array().cast("array<string>")
    terms = F.array_distinct(F.concat(F.coalesce(retrieval_terms(F.col("user"), 8), none), F.coalesce(retrieval_terms(F.substring("model", 1, 600), 8), none)))
    query = trimmed(F.coalesce("message", F.lit("")))
    return rows.select("conv_id", F.when(is_follow_up(query) & (F.size(terms) > 0), F.concat(query, F.lit(" "), F.array_join(terms, " "))).otherwise(query).alias("query"))


def expanded(query: Column) -> Column:
    """The query, and a variant of its code symbols where it has any."""
    q = trimmed(F.coalesce(query, F.lit("")))
    found = F.filter(F.regexp_extract_all(q, F.lit("[a-zA-Z_][A-Za-z0-9_]+"), F.lit(0)), lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*EXPANSION_STOP) & (s.rlike("[A-Z]") | F.contains(s, F.lit("_")) | (F.length(s) >= 6)))
    variant = F.concat(F.array_join(found, " "), F.lit(" implementation definition"))
    return F.when((F.size(found) == 0) | (variant == q), F.array(q)).otherwise(F.array(q, variant))


#: Patterns of questions about a whole project, and of questions for a fact.
OVERVIEW = (
    ascii_word("what does|what is|tell me about") + ".*" + ascii_word("project|repo|repository"),
    ascii_word("project|repo|repository") + ".*" + ascii_word("overview|summary|purpose|about"),
    ascii_word(r"(?:main|key)\s+(?:entry\s+points?|components|modules|data\s+flow|architecture)"),
    ascii_word(r"high[-\s]?level|big picture"),
)
FACT = (
    ascii_word(r"hyperparameter|dropout|temperature|top[_\s-]?p|top[_\s-]?k|learning[_\s-]?rate|batch[_\s-]?size"),
    ascii_word("default|exact|specific|numeric|number|value|values|setting|settings|config|configuration"),
    r"^\s*(?:how many|where)(?![A-Za-z0-9_])",
)


def matches_any(text: Column, patterns) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in patterns:
        out = out | low.rlike(p)
    return out


def without_flags(query: Column) -> Column:
    """The query without requests for a drawing."""
    return trimmed(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?i)/(?:diagram|visualization|viz)(?![A-Za-z0-9_])", ""))


def history_window(turns: DataFrame, most: int) -> DataFrame:
    """The last ``most`` turns before the last question, system turns aside, numbered from the oldest."""
    last = last_user_turns(turns).select("conv_id", "at")
    prior = turns.where("role <> 'system'").join(last, "conv_id").where("turn < at")
    by = Window.partitionBy("conv_id")
    kept = prior.withColumn("back", F.row_number().over(by.orderBy(F.desc("turn")))).where(F.col("back") <= most)
    return kept.select("conv_id", "turn", "role", "text", F.row_number().over(by.orderBy("turn")).alias("n"))


def islands(turns: DataFrame) -> DataFrame:
    """``conv_id, island, role, text``: neighbouring turns of one role as one, without blank turns, from the first to the last island of a user."""
    spoken = turns.where("role <> 'system'").where(trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise("user"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    marked = spoken.withColumn("new", (F.coalesce(F.lag("role").over(by), F.lit("")) != F.col("role")).cast("int")).withColumn("island", F.sum("new").over(by))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    merged = marked.groupBy("conv_id", "island", "role").agg(joined.alias("text"))
    every = Window.partitionBy("conv_id")
    user = F.when(F.col("role") == "user", F.col("island"))
    return merged.withColumns({"lo": F.min(user).over(every), "hi": F.max(user).over(every)}).where("island between lo and hi").select("conv_id", "island", "role", "text")


def prompts(turns: DataFrame) -> DataFrame:
    """``conv_id, history, prompt``: the last island is the prompt; the first system turn leads the first island of a user."""
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    parts = islands(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("island", "role", "text"))).alias("p"))
    rows = parts.join(system, "conv_id", "left").withColumn("lead", F.when(F.col("system") != "", F.concat("system", F.lit(SEPARATOR))).otherwise(F.lit("")))
    texts = F.transform("p", lambda x, i: F.when(i == 0, F.concat("lead", x["text"])).otherwise(x["text"]))
    return rows.select("conv_id", F.slice(texts, 1, F.size("p") - 1).alias("history"), F.element_at(texts, -1).alias("prompt"))


def titles(turns: DataFrame, fallback: str = "New chat", most: int = 40) -> DataFrame:
    """``conv_id, title``: the first question that isn't blank, white space folded, cut after ``most`` characters."""
    asked = (F.col("role") == "user") & (trimmed(F.coalesce("text", F.lit(""))) != "")
    first = turns.groupBy("conv_id").agg(F.min_by(F.when(asked, F.col("text")), F.when(asked, F.col("turn"))).alias("text"))
    compact = F.regexp_replace(trimmed(F.col("text")), r"[ \t\n\r\f\x0b]+", " ")
    return first.select("conv_id", F.when(F.col("text").isNull(), fallback).when(F.length(compact) > most, F.concat(F.substring(compact, 1, most), F.lit("..."))).otherwise(compact).alias("title"))


def think_split(text: Column) -> tuple[Column, Column]:
    """Hidden thoughts and the visible rest of a model's answer; a thought that isn't closed hides all that follows."""
    text = F.coalesce(text, F.lit(""))
    hidden = F.regexp_extract(text, r"(?s)<think>(.*?)(?:</think>|\z)", 1)
    return trimmed(hidden), trimmed(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", ""))


def claims(text: Column) -> Column:
    """Lines of a numbered list, without their numbers."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trimmed(x).rlike(r"^[0-9]+[.)]"))
    return F.transform(lines, lambda x: trimmed(F.regexp_replace(x, r"^[0-9]+[.)]\s*", "")))


#: What errors say that ask for a token, and that ask for other settings.
TOKEN_ERRORS = ("private", "not found", "token", "rate limit", "denied", "permission", "403", "401")
SETTING_ERRORS = ("gemini", "groq", "api key", "authentication", "unauthorized", "invalid", "rejected", "permission", "forbidden", "webgpu", "web-llm", "local web", "unlock")


def says_any(text: Column, parts) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def variant_lines(reply: Column, query: Column, most: int = 4) -> Column:
    """Query variants out of a model's reply: the query first, numbering stripped, 3 to 249 characters, no repeats but for case."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: trimmed(F.regexp_replace(x, r"^\s*(?:[0-9]+[.)]|[-*])\s*", ""))), lambda x: (F.length(x) > 2) & (F.length(x) < 250))
    every = F.concat(F.array(query), lines)
    kept = F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)
    return F.slice(kept, 1, most)


def refined_query(reply: Column, most: int = 200) -> Column:
    """The follow-up search that a model asks for: null where it finds the evidence sufficient or says nothing."""
    text = trimmed(F.coalesce(reply, F.lit("")))
    return F.when((text != "") & ~F.upper(text).startswith("SUFFICIENT"), F.substring(text, 1, most))
