"""SimHash near-dedup with multi-index hashing.

A fingerprint has 64 bits, each the majority of one bit over the hashes of the
document's word shingles. Two fingerprints that differ in at most 3 bits differ
in at most one bit in one of their two 32-bit segments. So for each segment the
ball of radius one around its value is enumerated, the table of segments is
asked for those values, and the whole distance is verified on what it has.

Distinct fingerprints only are searched, so copies cost nothing; documents come
back through a join that adaptive execution splits where one fingerprint is
frequent. Neither documents, links nor components pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmesh.llm.components import connected
from quillmesh.llm.tokens import steps
from quillmesh.workspace import regrouped, stored

BITS, SEGMENTS = 64, 2


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a text of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: n - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def votes(hashes: np.ndarray) -> np.ndarray:
    """In how many rows each bit is set; hashes: rows of one or more words of 64 bits."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8), axis=1, bitorder="little")
    out = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # eight sums in a word, of at most 255 each
        out += bits[at : at + 255].view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return out


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    h = shingle_hashes(text, words, seed)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):  # bounds the arrays of a very long text
        total += votes(h[at : at + 65536, None])
    return int(sum(1 << i for i in np.flatnonzero(2 * total > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` (a signed 64-bit integer) of every row."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fps = np.array([simhash(t or b"", words, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType, True), StructField("fp", LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def links(values: DataFrame, most: int = 3) -> DataFrame:
    """``a, b``: pairs of the distinct ``fp`` of ``values`` that differ in at most ``most`` bits, below 4.

    Of two segment values that differ in one bit, the one without it finds the
    other, so each pair is looked up once for a segment. A pair can come twice.
    """
    if not 0 <= most < 2 * SEGMENTS:
        raise ValueError("balls of radius one in two segments reach 3 bits")
    seg = F.explode(F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("v")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"))))
    table = values.select("fp", seg.alias("s")).select("fp", "s.seg", "s.v")
    ball = table.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(31))))
    flipped = F.col("v").bitwiseOR(F.expr("shiftleft(1L, greatest(bit, 0))"))
    ball = ball.where((F.col("bit") < 0) | (flipped != F.col("v"))).select(F.col("fp").alias("a"), F.col("seg").alias("ps"), F.when(F.col("bit") < 0, F.col("v")).otherwise(flipped).alias("pv"), (F.col("bit") < 0).alias("same"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= most
    return ball.join(table.hint("merge"), (F.col("ps") == F.col("seg")) & (F.col("pv") == F.col("v")) & close & (~F.col("same") | (F.col("a") < F.col("fp")))).select("a", F.col("fp").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id, links``.

    ``component_id`` is the smallest id that links reach; ``links`` counts the
    other distinct fingerprints that the row's fingerprint links to.

    Edge cases: a null text counts as empty; texts without words have the
    fingerprint zero and link like all others; a null id is never a component's
    id unless all of its ids are null; rows that repeat an id are rows of their
    own; an empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words, seed), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    pairs = stored(links(classes.select("fp"), most).distinct(), "simhash-links")
    roots = connected(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").join(degree.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return prints.join(regrouped(named, "fp").hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; rows without an id stay.

    Edge cases as in ``near_groups``: texts without words are alike, null ones
    among them; of rows that repeat the smallest id of a group all stay; a text
    of any length counts whole; an empty table stays empty; all columns pass.
    """
    kept = near_groups(docs, id_col, text_col, **options).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__id"))
    return docs.join(kept, F.col(id_col) == F.col("__id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
