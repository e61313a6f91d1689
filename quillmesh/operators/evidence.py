"""Evidence and citations: which results hold the terms that an answer needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def haystack(file: Column, code: Column) -> Column:
    return F.lower(F.concat(file, F.lit("\n"), F.coalesce(code, F.lit(""))))


def _held(terms: Column, hay: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(hay, t))


def coverage(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``query_id, terms, matched, missing, best``. queries: ``query_id, terms``; results: ``query_id, file, code, score``."""
    rows = queries.join(results.select("query_id", haystack(F.col("file"), F.col("code")).alias("hay"), "score"), "query_id", "left")
    each = rows.select("query_id", "terms", "score", F.coalesce(_held(F.col("terms"), F.col("hay")), F.array().cast("array<string>")).alias("held"))
    out = each.groupBy("query_id", "terms").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("any"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    return out.select("query_id", "terms", F.array_intersect("terms", "any").alias("matched"), F.array_except("terms", "any").alias("missing"), "best")


def blocked(covered: DataFrame, fact_seeking: Column, least: float = 0.35) -> Column:
    """Whether an answer is withheld: a question for a fact with sparse or weak evidence."""
    n = F.size("terms")
    return fact_seeking & ((n == 0) | ((F.col("best") < least) & (F.size("matched") < F.ceil(n / 3))))


def grounded(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results of a positive score that hold a term of their query, or all of them where none does."""
    rows = results.where("score > 0").join(queries.select("query_id", "terms"), "query_id")
    marked = rows.withColumn("held", F.size(_held(F.col("terms"), haystack(F.col("file"), F.col("code")))) > 0)
    any_ = F.bool_or("held").over(Window.partitionBy("query_id"))
    return marked.withColumn("any", any_).where("held or not any").drop("held", "any", "terms")


def correlated(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Results that an answer correlates with, best first. answers: ``query_id, query_terms, answer_terms, answer`` in lower case."""
    rows = results.where("score > 0").join(answers, "query_id").withColumn("hay", haystack(F.col("file"), F.col("code")))
    rows = rows.withColumns({"q": F.size(_held(F.col("query_terms"), F.col("hay"))), "a": F.size(_held(F.col("answer_terms"), F.col("hay"))), "named": F.contains("answer", F.lower("file"))})
    rows = rows.withColumn("correlation", F.col("a") * 3 + F.col("q") + F.when(F.col("named"), 4).otherwise(0) + F.least(F.lit(2.0), F.col("score") * 2))
    kept = rows.where("named or a > 0 or (q >= 2 and score >= 0.55)")
    order = [F.round("correlation", 9).desc(), F.round("score", 9).desc(), F.col("id")]
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "id", "file", "score", "correlation", "rank")


def by_file(results: DataFrame, most: int = 6) -> DataFrame:
    """A citation for each file: its lines, its best score and how many results; the best files of each query."""
    rows = results.groupBy("query_id", "file").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.max("score").alias("score"), F.count("*").alias("n"))
    order = [F.round("score", 9).desc(), F.col("file")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)
