"""Exact nearest sign bits out of tables of their segments.

A code of ``dims`` bits has segments of ``width``. Codes that differ in at most
``s * (r + 1) - 1`` bits differ in at most ``r`` bits in one of their ``s``
segments. So a query asks the table for the values around its own segments, at a
radius that grows by one from round to round, and is done when it has found as
many codes as it wants within the distance that its radius proves. Only queries
that aren't done ask again; what is not done when a further round would find
more than a scan reads is held against all codes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.vectors import hamming_words
from quillmesh.operators.bm25 import top
from quillmesh.operators.retrieval import hamming_search
from quillmesh.workspace import stored

WIDTH = 16
#: Part of all codes that a round's candidates may be, by expectation, before the rest is scanned.
SHARE = 0.05


def _segments(bits, dims: int, width: int):
    """Number and value of each segment of a code in words of 32 bits."""
    part = lambda i: F.shiftright(F.get(bits, F.lit(i * width // 32)), i * width % 32).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.struct(F.lit(i).alias("seg"), part(i).alias("value")) for i in range(dims // width)))


def segment_table(codes: DataFrame, dims: int = 64, width: int = WIDTH) -> DataFrame:
    """``seg, value, id, bits``: a row for each segment of each code ``id, bits``; can be written once and asked often."""
    if 32 % width or dims % width:
        raise ValueError("segments lie inside words of 32 bits and cover the code")
    return codes.select("id", "bits", F.explode(_segments(F.col("bits"), dims, width)).alias("s")).select("s.seg", "s.value", "id", "bits")


def rounds(dims: int, width: int, share: float = SHARE) -> int:
    """How many rounds expect fewer candidates than ``share`` of all codes."""
    n, r, seen = dims // width, 0, 0
    while r <= width and (seen := seen + n * comb(width, r)) <= share * 2**width:
        r += 1
    return r


def _around(width: int, radius: int):
    """Masks of ``radius`` bits of a segment."""
    return F.array(*(F.lit(sum(1 << b for b in bits)).cast("long") for bits in combinations(range(width), radius)))


def table_search(codes: DataFrame, queries: DataFrame, limit: int = 50, dims: int = 64, width: int = WIDTH, share: float = SHARE, table: DataFrame | None = None) -> DataFrame:
    """``query_id, id, dist, score, rank, round, candidates``: the rows of ``hamming_search``, with the round in which a query was done and the candidates that it had met.

    codes: ``id, bits``; queries: ``query_id, qbits``; ``table`` is their
    ``segment_table``, if it was made before. ``round`` is -1 where all codes
    were read. Fewer codes than ``limit`` are never enough, so all are read.
    """
    segments, words = dims // width, -(-dims // 32)
    table = stored(segment_table(codes, dims, width), "segments") if table is None else table
    open_, met, done = stored(queries.select("query_id", "qbits"), "asking"), None, None
    for r in range(rounds(dims, width, share)):
        asked = open_.select("query_id", "qbits", F.explode(_segments(F.col("qbits"), dims, width)).alias("s")).select("query_id", "qbits", F.col("s.seg").alias("qs"), F.explode(F.transform(_around(width, r), lambda m: m.bitwiseXOR(F.col("s.value")))).alias("qv"))
        new = asked.join(table, (F.col("qs") == F.col("seg")) & (F.col("qv") == F.col("value"))).select("query_id", "id", hamming_words(F.col("bits"), F.col("qbits"), words).alias("dist"))
        if met is not None:
            new = new.unionByName(met.join(open_.select("query_id"), "query_id", "left_semi"))
        met = stored(new.distinct(), "met")
        proven = segments * (r + 1) - 1
        counts = met.groupBy("query_id").agg(F.count_if(F.col("dist") <= proven).alias("sure"), F.count("*").alias("candidates")).where(F.col("sure") >= limit)
        ready = stored(counts.select("query_id", "candidates", F.lit(r).alias("round")), "ready")
        found = top(met.join(ready, "query_id"), limit, by=[F.col("dist"), F.col("id")])
        done = found if done is None else done.unionByName(found)
        open_ = stored(open_.join(ready, "query_id", "left_anti"), "asking")
        if open_.isEmpty():
            return done.withColumn("score", 1 / (1 + F.col("dist"))).select("query_id", "id", "dist", "score", "rank", "round", "candidates")
    n = codes.count()
    rest = hamming_search(codes, open_, limit, dims).select("query_id", "id", "dist", "rank", F.lit(-1).alias("round"), F.lit(n).cast("long").alias("candidates"))
    every = rest if done is None else done.select(rest.columns).unionByName(rest)
    return every.withColumn("score", 1 / (1 + F.col("dist"))).select("query_id", "id", "dist", "score", "rank", "round", "candidates")
