"""Files of repositories out of a folder, and lines of streamed replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.paths import is_indexable, priority


def read_files(spark: SparkSession, root: str, repo: str = "repo") -> DataFrame:
    """``repo, path, size, sha, content`` of all files below a folder, on any file system that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/"
    path = F.substring_index("path", base, -1)
    return rows.select(F.lit(repo).alias("repo"), path.alias("path"), F.col("length").alias("size"), F.sha2(F.col("content"), 256).alias("sha"), F.decode("content", "UTF-8").alias("content"))


def indexable_files(files: DataFrame) -> DataFrame:
    """The files that are indexed, with the order in which they are."""
    return files.where(is_indexable(F.col("path"))).withColumn("priority", priority(F.col("path")))


def require_whole(files: DataFrame, truncated) -> DataFrame:
    """Fails when a listing is cut short: an index of a part would pass for one of the whole."""
    return files.where(F.when(truncated, F.raise_error(F.lit("the file listing is truncated"))).otherwise(F.lit(True)).cast("boolean"))


def ndjson_text(lines: DataFrame, by: str = "id", order: str = "n", value: str = "value") -> DataFrame:
    """``by, text, error`` out of lines of JSON objects: chunks of text in order, and the first error."""
    rows = lines.withColumn("x", F.from_json(value, "type string, text string, error string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x.type") == "chunk", F.struct(F.col(order).alias("n"), F.col("x.text").alias("t"))))), lambda s: s["t"]), "")
    return rows.groupBy(by).agg(text.alias("text"), F.min_by(F.when(F.col("x.type") == "error", F.col("x.error")), F.when(F.col("x.type") == "error", F.col(order))).alias("error"))


def sse_data(lines: DataFrame, value: str = "value") -> DataFrame:
    """Payloads of server-sent events, without the closing one."""
    data = F.trim(F.regexp_extract(value, r"^data:\s?(.*)$", 1))
    return lines.where(F.startswith(value, F.lit("data:"))).withColumn("data", data).where(F.col("data") != "[DONE]")
