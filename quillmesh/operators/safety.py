"""Instructions hidden in retrieved texts: scanning, grading, redacting and dropping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ascii_word

#: Name, weight and the words of each pattern.
PATTERNS = (
    ("ignore_previous_instructions", 6, ascii_word("ignore") + r"[\s\S]{0,50}" + ascii_word("previous|prior|above") + r"[\s\S]{0,30}" + ascii_word("instructions?|rules?")),
    ("system_prompt_override", 5, ascii_word("system prompt|developer message|override.*instructions?|new system instructions?")),
    ("role_takeover", 4, ascii_word("you are now|act as|pretend to be|roleplay")),
    ("safety_bypass", 6, ascii_word("jailbreak|bypass safety|disable safety|ignore safety policy")),
    ("secret_exfiltration", 7, ascii_word("reveal|print|dump|exfiltrat[A-Za-z0-9_]*") + r"[\s\S]{0,60}" + ascii_word(r"api[_\s-]?key|secret|token|password|credentials?")),
    ("tool_execution_coercion", 4, ascii_word("execute command|run this command|call tool|function call|shell command")),
)
CONSIDERED, RISKY, MOST_HITS = 8, 6, 2
REMOVED = "[UNTRUSTED_INSTRUCTION_REMOVED]"
DROP_RATIO, DROP_RATIO_DOC = 0.4, 0.2


def _hits(text: Column) -> list[Column]:
    return [F.least(F.regexp_count(text, F.lit("(?i)" + p)), F.lit(MOST_HITS)) for _, _, p in PATTERNS]


def graded(score: Column, risky: Column, considered: Column) -> Column:
    """The level of risk of a query's results."""
    dominance = risky / F.greatest(considered, F.lit(1))
    many = lambda part: (risky >= 2) & (dominance >= part)
    return F.when((considered == 0) | ((score < 4) & (risky == 0)), "none").when((score >= 18) | many(0.5), "high").when((score >= 9) | many(0.3), "medium").otherwise("low")


def scan(results: DataFrame) -> DataFrame:
    """``query_id, considered, score, risky, risky_ids, signals, level, strict`` over the first eight results of every query.

    results: ``query_id, rank, id, file, code, score``. Signals are the names of
    the patterns that were found, the most frequent first.
    """
    first = results.where(F.col("rank") <= CONSIDERED)
    text = F.concat("file", F.lit("\n"), F.coalesce("code", F.lit("")))
    rows = first.select("query_id", "id", "rank", "score", F.array(*_hits(text)).alias("hits"))
    own = reduce(lambda a, b: a + b, (F.col("hits")[i] * w for i, (_, w, _) in enumerate(PATTERNS)))
    rows = rows.withColumn("own", own).withColumn("weighted", F.col("own") * F.when(F.col("score") > 0, 1.0).otherwise(0.6))
    bad = F.col("own") >= RISKY
    found = F.array(*[F.struct((-F.sum(F.col("hits")[i])).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, _, _) in enumerate(PATTERNS)])
    sums = rows.groupBy("query_id").agg(F.count("*").alias("considered"), F.sum("weighted").alias("score"), F.count_if(bad).alias("risky"), F.array_sort(F.collect_list(F.when(bad, F.struct("rank", "id")))).alias("r"), found.alias("found"))
    signals = F.transform(F.filter(F.array_sort("found"), lambda x: x["n"] < 0), lambda x: x["name"])
    level = graded(F.col("score"), F.col("risky"), F.col("considered"))
    strict = (level == "high") | (F.col("risky") >= F.greatest(F.lit(2), F.ceil(F.least(F.col("considered"), F.lit(5)) / 2)))
    return sums.select("query_id", "considered", F.round("score", 2).alias("score"), "risky", F.transform("r", lambda x: x["id"]).alias("risky_ids"), signals.alias("signals"), level.alias("level"), strict.alias("strict"))


def _spans_lines(text: Column) -> Column:
    """Numbers of the lines that a match over several lines touches: the text in front of a match tells where it starts."""
    none = F.array().cast("array<int>")
    out = none
    for _, _, p in PATTERNS:
        found = F.regexp_extract_all(text, F.lit("(?i)(" + p + ")"), F.lit(1))
        start = lambda m: F.size(F.split(F.call_function("substring_index", text, m, F.lit(1)), "\n")) - 1
        out = F.concat(out, F.flatten(F.transform(F.filter(found, lambda m: F.contains(m, F.lit("\n"))), lambda m: F.sequence(start(m), start(m) + F.size(F.split(m, "\n")) - 1))))
    return F.array_distinct(out)


def redacted(code: Column, across_lines: bool = True) -> tuple[Column, Column, Column]:
    """The text with risky lines replaced, how many those are, and their part of all lines.

    A match that runs over several lines takes all of them, unless
    ``across_lines`` is off and lines are judged one by one.
    """
    text = F.coalesce(code, F.lit(""))
    lines = F.split(text, "\n", -1)
    any_ = "(?i)" + "|".join(p for _, _, p in PATTERNS)
    touched = _spans_lines(text) if across_lines else F.array().cast("array<int>")
    clean = F.transform(lines, lambda x, i: F.when(x.rlike(any_) | F.array_contains(touched, i), F.lit(REMOVED)).otherwise(x))
    count = F.size(F.filter(lines, lambda x, i: x.rlike(any_) | F.array_contains(touched, i)))
    return F.array_join(clean, "\n"), count, count / F.size(lines)


def dropped(file: Column, node_type: Column, ratio: Column) -> Column:
    """Whether so much of a chunk is redacted that it goes; documentation goes earlier."""
    doc = F.lower(file).rlike(r"\.(md|txt|rst)$") | (node_type == "text_chunk")
    return (ratio >= DROP_RATIO) | (doc & (ratio >= DROP_RATIO_DOC))


def safe_results(results: DataFrame, scanned: DataFrame) -> DataFrame:
    """Results with risky chunks redacted or dropped; ``cited`` is false for every risky one, ``redactions`` counts lines.

    If nothing would be left of a query, its results that aren't risky are what there is.
    """
    rows = results.join(scanned.select("query_id", "risky_ids"), "query_id", "left")
    risky = F.coalesce(F.array_contains("risky_ids", F.col("id")), F.lit(False))
    text, count, ratio = redacted(F.col("code"))
    rows = rows.withColumns({"risky": risky, "clean": text, "n": count, "ratio": ratio})
    kept = rows.where(~F.col("risky") | ~dropped(F.col("file"), F.col("node_type"), F.col("ratio")))
    return kept.select("query_id", "rank", "id", "file", "node_type", "score", F.when(F.col("risky"), F.col("clean")).otherwise(F.col("code")).alias("code"), (~F.col("risky")).alias("cited"), F.when(F.col("risky"), F.col("n")).otherwise(0).alias("redactions"))
