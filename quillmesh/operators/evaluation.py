"""Recall, reciprocal rank and discounted gain of ranked lists against relevance judgements."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(runs: DataFrame, qrels: DataFrame, queries: DataFrame, by: tuple[str, ...] = (), k: int = 5, depth: int = 10) -> DataFrame:
    """``*by, query_id, recall, mrr, ndcg`` for every query of every run.

    runs: ``*by, query_id, id, rank`` from 1; qrels: ``query_id, id, relevance``.
    Recall is over the first ``k``, the gain 2**relevance - 1 over the first
    ``depth``, the reciprocal rank over all that the run returns.
    """
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ranked = qrels.where("relevance > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")))
    ideal = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= depth, gain / F.log2(F.col("i") + 1))).alias("ideal"))
    hits = runs.join(qrels.where("relevance > 0"), ["query_id", "id"])
    sums = hits.groupBy(*by, "query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= depth, gain / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    every = runs.select(*by).distinct().crossJoin(queries.select("query_id").distinct()) if by else queries.select("query_id").distinct()
    joined = every.join(sums, [*by, "query_id"], "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(*by, "query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def measured(configurations: dict, queries: DataFrame, warmups: int = 2, samples: int = 3, each: int = 0) -> DataFrame:
    """``config, query_id, sample, micros``: how long configurations take, for ``latency_summary``.

    A configuration is a function from a DataFrame of queries to its results, all
    columns of which are computed and thrown away. It first runs ``warmups`` times
    over what is measured, so that plans are compiled and files are known, and
    then ``samples`` times. All queries are one batch, of whose time each has an
    equal share; with ``each``, that many queries, the first by id, run one by one.
    """
    spark, taken = queries.sparkSession, []
    if each:
        ids = [r[0] for r in queries.select("query_id").orderBy("query_id").limit(each).collect()]  # as many as asked for
        batches = {(i,): queries.where(F.col("query_id") == F.lit(i)) for i in ids}
    else:
        batches = {None: queries}
    for name, run in configurations.items():
        for ids, batch in batches.items():
            for n in range(-warmups, samples):
                began = time.perf_counter()
                run(batch).write.format("noop").mode("overwrite").save()
                if n >= 0:
                    taken.append((name, ids and ids[0], n, (time.perf_counter() - began) * 1e6))
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = spark.createDataFrame(taken, f"config string, query_id {kind}, sample int, micros double")
    if each:
        return rows
    n = max(1, queries.count())
    return rows.drop("query_id").join(queries.select("query_id"), how="cross").select("config", "query_id", "sample", (F.col("micros") / n).alias("micros"))


def latency_summary(samples: DataFrame, by: tuple[str, ...] = ("config",)) -> DataFrame:
    """The mean over queries of the median of their samples. samples: ``*by, query_id, micros``."""
    return samples.groupBy(*by, "query_id").agg(F.median("micros").alias("m")).groupBy(*by).agg(F.count("*").alias("queries"), F.avg("m").alias("micros"))


def graded_qrels(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """File-level judgements, ``query_id, id, relevance``: 2 for the primary ones, 1 for others."""
    both = primary.select("query_id", "id", F.lit(2).alias("relevance")).unionByName(secondary.select("query_id", "id", F.lit(1).alias("relevance")))
    return both.groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))


def hard_negatives(qrels: DataFrame, pool: DataFrame, each: int, seed: str = "neg") -> DataFrame:
    """``each`` documents of the pool for every query that aren't judged, by a hash of both; pool: ``query_id, id``."""
    rest = pool.join(qrels.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("id").cast("string")))
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("n") <= each).select("query_id", "id", F.lit(0).alias("relevance"))
