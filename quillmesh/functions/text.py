"""Text expressions: tokenising, symbols and trimming, all as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.words import EVIDENCE_STOP, EXPANSION_STOP, SEARCH_STOP, SUMMARY_STOP

#: White space that is trimmed from both ends.
BLANK = " \t\n\r\f\x0b"


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANK))


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def in_words(col: Column, words) -> Column:
    """Whether a string is one of a fixed list; stays a hash lookup in generated code."""
    return col.isin(*words)


def identifiers(text: Column) -> Column:
    """All identifiers and numbers of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))


def _split_case(t: Column) -> Column:
    """An identifier in lower case, cut where camel case or snake case changes."""
    return F.split(F.lower(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")), "[_ ]+")


def token_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a row for each search token in place of the column ``text``, named ``term``.

    The tokens of ``code_tokens``, without lambdas: identifiers become rows
    first, and what follows are plain columns in generated code. The outer
    explode keeps the optimiser from tokenising once more to filter empty texts.
    """
    rest = [F.col(c) for c in df.columns if c != text]
    ids = df.select(*rest, F.explode_outer(identifiers(F.col(text))).alias("__t")).where("__t is not null").withColumn("__w", F.lower("__t"))
    parts = F.array_remove(F.array_remove(_split_case(F.col("__t")), F.lit("")), F.col("__w"))
    tokens = F.when(F.col("__t").rlike("[a-z0-9][A-Z]|_"), F.concat(F.array("__w"), parts)).otherwise(F.array("__w"))
    return ids.select(*rest, F.explode_outer(tokens).alias("term")).where((F.length("term") >= 2) & ~F.col("term").isin(*SEARCH_STOP))


def code_tokens(text: Column) -> Column:
    """Search tokens: identifiers in lower case, then their camel-case and snake-case parts where they differ; no stop words, two characters at least."""
    parts = lambda t: F.filter(F.split(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2"), "[_ ]+"), lambda p: (p != "") & (F.lower(p) != F.lower(t)))
    every = F.flatten(F.transform(identifiers(text), lambda t: F.concat(F.array(t), parts(t))))
    return F.filter(F.transform(every, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*SEARCH_STOP))


def words(text: Column) -> Column:
    """Runs of ASCII word characters in lower case: what lies between two word boundaries."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def query_symbols(query: Column, distinct: bool = True) -> Column:
    """Symbols of a query: words of a letter and more, in lower case, that are no stop words."""
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("[a-zA-Z_][A-Za-z0-9_]+"), F.lit(0)), F.lower), lambda t: ~t.isin(*SEARCH_STOP))
    return F.array_distinct(found) if distinct else found


def evidence_terms(query: Column, most: int = 12) -> Column:
    """Terms that an answer's sources should hold: distinct, three characters at least, the first ``most``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9][a-z0-9._/-]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*EVIDENCE_STOP))), 1, most)


def summary_tokens(query: Column) -> Column:
    """Tokens that are looked for in summaries."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), "[^A-Za-z0-9_]+"), lambda t: (F.length(t) > 1) & ~t.isin(*SUMMARY_STOP))


def retrieval_terms(text: Column, most: int) -> Column:
    """Distinct words of three characters and more that a follow-up question takes over."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z_][A-Za-z0-9_]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*EXPANSION_STOP))), 1, most)


def ascii_word(pattern: str) -> str:
    """A pattern between ASCII word boundaries; Java's own boundaries know all of Unicode."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"
