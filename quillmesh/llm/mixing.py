"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ordered
by that key; running sums of their sizes tell how far a budget reaches. The key
space is cut into equal ranges, so many that a range of one source holds a
bounded number of rows however large the source is: sums within a range are a
window over that range, and sums over ranges are a window over one row for each
range. A source whose target exceeds its size is taken in whole epochs first;
the rest of the target is cut from one more epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.workspace import stored

#: What the query's sources weigh, repeating in code point order of their names.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from one row of ``source, source_size`` for each source.

    The total of ``share`` times all sizes is shared by weight. A target stops
    at ``most`` times its source's size and the excess is shared again by weight
    among the others, until none is above. That is the smallest common level L
    with target = min(most * size, weight * L): sources ordered by size / weight
    fill up in that order, so L follows from running sums over the sources.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("source_size") / F.col("w"))
    rank = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, on, all_ = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(all_) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(on))
    # the level counts at the first source, in that order, that it doesn't fill
    level = F.min_by(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("ratio"))).over(all_)
    return s.withColumn("common", level).select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", rows_per_range: int = 4_000) -> DataFrame:
    """One row per input row: ``id_col, source, size, source_size, target, taken``.

    ``taken`` is the number of the document's words that the mix takes, with
    repeats: whole epochs, and in the last one all words before the cut. The
    taken words of a source add up to its target, rounded down. Ranges of keys
    have about ``rows_per_range`` rows; there are 65,536 at most, so beyond 262
    million rows they grow with the table.

    Edge cases: a null text has size 0 and is never taken; a null source is a
    source of its own and comes last; rows that repeat an id are separate rows,
    ordered among themselves by size, and equal rows are interchangeable; an
    empty table gives no rows; other columns are not read.
    """
    # rows without an id are spread by their texts, so that they don't share one range of keys
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))))
    narrow = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix")
    ranges = max(1, min(65536, -(-narrow.count() // rows_per_range)))
    ranged = narrow.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = sums.select("source", "range", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    plan = starts.withColumnsRenamed({"source": "ps", "range": "pr"}).join(targets.withColumnRenamed("source", "ts"), F.col("ps").eqNullSafe(F.col("ts"))).drop("ts")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("range") == F.col("pr")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("local")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each time that a document is taken.

    A document of which any word of an epoch is taken is there whole for that
    epoch, so at most one document of a source exceeds the cut. Documents that
    are not taken, such as those without words, go. Of rows that repeat an id,
    each is there as often as the one taken most. Columns are those of ``docs``,
    whatever their names. Rows are in a hash-random order of document and epoch,
    so the epochs of a document lie apart.

    Edge cases as in ``mix``: rows without words go, null ids and null sources
    count like others, and an empty table stays empty.
    """
    times = F.max(F.ceil(F.col("taken") / F.col("size")).cast("int"))
    taken = mix(docs, id_col, **options).where("taken > 0").groupBy(F.col(id_col).alias("id")).agg(times.alias("times")).alias("taken")
    own = docs.alias("docs")
    joined = own.join(taken, F.col(f"docs.`{id_col}`").eqNullSafe(F.col("taken.id")))
    epochs = joined.select(F.struct("docs.*").alias("doc"), F.explode(F.sequence(F.lit(1), F.col("taken.times"))).alias("epoch"))
    spread = F.xxhash64(F.col(f"doc.`{id_col}`").cast("string"), "epoch")
    return epochs.withColumn("spread", spread).repartition("spread").sortWithinPartitions("spread").select("doc.*")
