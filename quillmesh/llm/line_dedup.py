"""Line dedup over levelled sorted runs of line hashes.

The store of known lines is a set of sorted runs, each a Parquet table ordered
by hash with one row per line: in how many documents it was found and the
largest id of those. A new batch of documents is reduced to such a table,
merge-anti-joined with the runs (lines on which the runs already decide
everything the batch could add are left out), and added as a run of its own.
When a level holds ``fanout`` runs they are merged into one run of the next
level, so a line is rewritten a logarithmic number of times.

Hot lines are safe: a document counts a line once before anything is shuffled,
counts are partial aggregations, and the join that brings the verdict back to
the occurrences is an ordinary shuffled join that adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.workspace import regrouped, stored

#: Characters stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def line_hash(line, min_chars: int):
    """128 bits of SHA-256 of the line's key; null where the key is too short."""
    key = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.substring(F.sha2(ascii_lower(key), 256), 1, 32)))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled store. ``levels[k]`` lists the sorted runs of level k."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20, fanout: int = 2):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame, id_col: str, text_col: str) -> None:
        """``add_hashes`` of a batch of texts."""
        hashes = F.transform(_lines(F.col(text_col)), lambda x: line_hash(x, self.min_chars))
        self.add_hashes(batch.select(F.col(id_col).alias("id"), hashes.alias("hashes")))

    def add_hashes(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch, ``id, hashes`` of each document's lines, with the runs and add what is new as a sorted run."""
        each = batch.select("id", F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
        own = each.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("id").alias("max_id"))
        for run in self.runs():
            full = run.where(F.col("n_docs") >= self.min_docs).select(F.col("h").alias("rh"), F.col("max_id").alias("rmax"))
            own = own.join(full, (F.col("h") == F.col("rh")) & (F.col("rmax") >= F.coalesce("max_id", "rmax")), "left_anti")
        self._push(0, own)

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(run.repartitionByRange("h").sortWithinPartitions("h"), f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(full))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, runs)
        return both.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))

    def repeated(self) -> DataFrame:
        """``h, max_id`` of the lines found in at least ``min_docs`` documents."""
        runs = self.runs()
        return self._merged(runs).where(F.col("n_docs") >= self.min_docs).select("h", "max_id")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed; adds ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z
    in lower case. A key of at least ``min_chars`` characters that is found in
    at least ``min_docs`` documents stays only in the largest id that holds it.
    All other lines stay as they are, joined by a newline.

    The rows go through the store in ``batches`` parts by a hash of the id,
    which together are all rows. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced.

    Edge cases: a null or empty text is one empty line and stays null or empty;
    a null id counts as smaller than every other; rows that repeat an id are
    documents of their own, told apart by a hash of their texts, and all of them
    keep a line of which theirs is the largest id; an empty table gives an empty
    table; extra columns pass through.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, min_docs, min_chars, fanout)
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), text_key.alias("k"))
    # texts are cut and hashed once, for the batches and for the way back
    hashed = stored(narrow.select("id", "k", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"), F.transform(_lines(F.col("t")), lambda x: line_hash(x, min_chars)).alias("hashes")), "line-hashes")
    for k in range(batches):
        store.add_hashes(hashed.where(F.col("batch") == k))
    repeated = store.repeated()
    held = hashed.select("id", "k", F.posexplode("hashes").alias("pos", "h")).where("h is not null")
    lost = held.join(regrouped(repeated, "h"), "h").where((F.col("id") < F.col("max_id")) | (F.col("id").isNull() & F.col("max_id").isNotNull()))
    drops = lost.groupBy("id", "k").agg(F.collect_set("pos").alias("__drops")).select(F.col("id").alias("__id"), F.col("k").alias("__k"), "__drops")
    # the lines are made before the shuffle of the join, so they are read and not split again for every index
    rows = docs.drop("n_lines", "n_dropped").withColumns({"__lines": _lines(F.col(text_col)), "__text_key": text_key})
    joined = rows.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__k")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(kept)
    out = joined.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long")).withColumn(text_col, text)
    out = out.withColumn("n_dropped", F.when(F.col("__drops").isNull(), F.lit(0)).otherwise(F.col("n_dropped")).cast("long"))
    return out.drop("__lines", "__drops", "__id", "__k", "__text_key")
