"""Evaluation sources: annotated queries and stored evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``language, query, url, relevance`` of a CSV file with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("Language").alias("language"), F.col("Query").alias("query"), F.col("GitHubUrl").alias("url"), F.col("Relevance").cast("int").alias("relevance"))


def annotated(rows: DataFrame, language: str, least: int, most: int | None = None) -> DataFrame:
    """``query, positives, judged`` of the queries of a language with at least ``least`` positives, those with the most first."""
    out = rows.where(F.lower("language") == language.lower()).groupBy("query").agg(F.count_if(F.col("relevance") > 0).alias("positives"), F.count("*").alias("judged")).where(F.col("positives") >= least)
    return out.orderBy(F.desc("positives"), "query").limit(most) if most else out


EVAL_SCHEMA = "queries array<struct<id:string,query:string,embedding:array<double>,relevantIds:array<string>,relevanceScores:map<string,int>>>, chunks array<struct<id:string,query_id:string,relevance:int,code:string,embedding:array<double>,language:string,filePath:string>>"
SUFFIXES = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "php": "php", "ruby": "rb", "rust": "rs"}


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, chunks and judgements of a stored evaluation set; relevance is clamped to 0 to 3."""
    doc = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)
    queries = doc.select(F.explode("queries").alias("q")).select("q.*")
    suffix = F.element_at(F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p]), F.lower("language"))
    chunks = doc.select(F.explode("chunks").alias("c")).select("c.*")
    chunks = chunks.withColumn("filePath", F.coalesce("filePath", F.concat(F.lit("eval/"), "id", F.lit("."), F.coalesce(suffix, F.lit("txt"))))).withColumn("name", F.regexp_extract(F.split("code", "\n")[0], r"(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", 1))
    qrels = queries.select(F.col("id").alias("query_id"), F.explode("relevanceScores").alias("id", "r")).select("query_id", "id", F.greatest(F.lit(0), F.least(F.lit(3), "r")).alias("relevance"))
    return queries, chunks, qrels
