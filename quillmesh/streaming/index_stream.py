"""Streams: running totals of metric events, and an index that follows a stream of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.incremental import operations
from quillmesh.operators.metrics import totals
from quillmesh.sources.commits import commit, log


def running_totals(events: DataFrame) -> DataFrame:
    """The counters of a stream of metric events; write it in complete mode."""
    return totals(events)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by kind and window of event time, later ones dropped after ``late``. An addition of this engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the batches whose ``base`` or ``changes`` are whole: those in the log."""
    return sorted(int(name.rpartition("=")[2]) for name in log(spark, path) if name.startswith(f"{kind}="))


def current(spark: SparkSession, path: str, upto: int | None = None, path_col: str = "path") -> DataFrame:
    """The index at ``path`` after batch ``upto``, or after the last one: the newest whole table and the changes since."""
    within = lambda versions: [v for v in versions if upto is None or v <= upto]
    base = within(committed(spark, path, "base"))[-1]
    index = spark.read.parquet(f"{path}/base/v={base}")
    since = [v for v in within(committed(spark, path, "changes")) if v > base]
    if not since:
        return index
    read = lambda name: reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/{name}/v={v}").withColumn("__v", F.lit(v)) for v in since))
    last = read("touched").groupBy(path_col).agg(F.max("__v").alias("__v"))
    return index.join(last.select(path_col), path_col, "left_anti").unionByName(read("rows").join(last, [path_col, "__v"]).select(index.columns))


def apply_batch(batch: DataFrame, number: int, base: DataFrame, read_fresh, path: str, merge_every: int = 16) -> None:
    """What ``follow_changes`` does with a batch. A batch that is in the log is done; what isn't in it is written again."""
    spark = batch.sparkSession

    def write(kind: str, v: int, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/v={v}")
        commit(spark, path, f"{kind}={v}", {"tables": sorted(tables)})

    if not committed(spark, path, "base"):
        write("base", -1, base=base)
    if number not in committed(spark, path, "changes"):
        ops = operations(batch)
        added = ops.where("op = 'add'").select("path").distinct()
        write("changes", number, touched=ops.select("path").distinct(), rows=read_fresh(spark, ops).join(added, "path", "left_semi"))
    if number % merge_every == merge_every - 1 and number not in committed(spark, path, "base"):
        write("base", number, base=current(spark, path, number))


def follow_changes(changes: DataFrame, base: DataFrame, read_fresh, path: str, checkpoint: str, merge_every: int = 16) -> StreamingQuery:
    """Keep the index at ``path`` up to date with a stream of changes; ``current`` reads it.

    A batch writes the paths that it touches and the rows of those that it adds,
    which ``read_fresh(spark, ops)`` gives, and then its line in a log; readers
    see what the log names, so a batch that died halfway is not there until it
    has run again. After every ``merge_every`` batches the whole table is
    written once. What is older than the newest whole table can be deleted.
    """
    apply = lambda batch, number: apply_batch(batch, number, base, read_fresh, path, merge_every)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
