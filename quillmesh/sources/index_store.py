"""The stored index: chunks by repository, with the snapshot and the model that they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(chunks: DataFrame, path: str, repo: str, sha: str, model: str) -> None:
    """Replace a repository's chunks; other repositories stay. Without chunks the repository goes."""
    if chunks.isEmpty():
        clear(chunks.sparkSession, path, repo)
        return
    rows = chunks.drop("repo", "sha", "model", "saved").withColumns({"repo": F.lit(repo), "sha": F.lit(sha), "model": F.lit(model), "saved": F.current_timestamp()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def load(spark: SparkSession, path: str, repo: str, sha: str | None = None, model: str | None = None) -> DataFrame:
    """A repository's chunks; none if they are of another snapshot or model than asked for."""
    rows = spark.read.parquet(path).where(F.col("repo") == repo)
    if sha is not None:
        rows = rows.where(F.col("sha") == sha)
    return rows if model is None else rows.where(F.col("model") == model)


def same_model(stored: str | None, current: str) -> bool:
    return stored == current


def clear(spark: SparkSession, path: str, repo: str | None = None) -> None:
    """Delete one repository, or all of them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path if repo is None else f"{path}/repo={repo}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)


def pending(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What is left of a job that was interrupted: files without a stored result."""
    return files.join(done.select(key).distinct(), key, "left_anti")
