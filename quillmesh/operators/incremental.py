"""Maintenance of an index by changes: what differs between two snapshots, and how it is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.paths import is_indexable

#: Changes up to which an index is updated in place; beyond, it is built anew.
MOST_CHANGES = 250


def compare_snapshots(base: DataFrame, head: DataFrame) -> DataFrame:
    """``filename, status, previous_filename`` from two tables ``path, sha``.

    A file that went while another one of the same content came is renamed: of
    several the first in order of their names. One full join by path, and one by
    content of what it leaves.
    """
    both = base.select("path", F.col("sha").alias("old")).join(head.select("path", F.col("sha").alias("new")), "path", "full")
    modified = both.where("old <> new").select(F.col("path").alias("filename"), F.lit("modified").alias("status"), F.lit(None).cast("string").alias("previous_filename"))
    went, came = both.where("new is null"), both.where("old is null")
    first = lambda df, sha: df.groupBy(F.col(sha).alias("sha")).agg(F.min("path").alias("path"))
    moved = first(went, "old").withColumnRenamed("path", "previous_filename").join(first(came, "new"), "sha")
    renamed = moved.select(F.col("path").alias("filename"), F.lit("renamed").alias("status"), "previous_filename")
    removed = went.join(moved.select(F.col("previous_filename").alias("path")), "path", "left_anti").select(F.col("path").alias("filename"), F.lit("removed").alias("status"), F.lit(None).cast("string").alias("previous_filename"))
    added = came.join(moved.select("path"), "path", "left_anti").select(F.col("path").alias("filename"), F.lit("added").alias("status"), F.lit(None).cast("string").alias("previous_filename"))
    return modified.unionByName(renamed).unionByName(removed).unionByName(added)


def operations(changes: DataFrame) -> DataFrame:
    """``op, path``: what to remove and what to add. Unknown kinds of change do nothing, nor do paths that aren't indexed."""
    op = lambda name, col: F.struct(F.lit(name).alias("op"), F.col(col).alias("path"))
    ops = (
        F.when(F.col("status") == "removed", F.array(op("remove", "filename")))
        .when(F.col("status") == "modified", F.array(op("remove", "filename"), op("add", "filename")))
        .when(F.col("status") == "added", F.array(op("add", "filename")))
        .when(F.col("status") == "renamed", F.array(op("remove", "previous_filename"), op("add", "filename")))
    )
    return changes.select(F.explode(ops).alias("x")).select("x.*").where("path is not null").where(is_indexable(F.col("path"))).distinct()


def apply_changes(index: DataFrame, ops: DataFrame, fresh: DataFrame, path_col: str = "path") -> DataFrame:
    """The index without removed paths and with the rows of ``fresh`` for added ones."""
    named = lambda op: ops.where(F.col("op") == op).select(F.col("path").alias(path_col)).distinct()
    return index.join(named("remove"), path_col, "left_anti").unionByName(fresh.join(named("add"), path_col, "left_semi"))


def rebuild_needed(changes: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """One row: whether there are too many changes to apply."""
    return changes.agg((F.count("*") > most).alias("rebuild"))
