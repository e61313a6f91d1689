"""Token ids in files: documents in ascending order of their ids, Simple-8b coded.

Documents are range-partitioned and sorted by id; each partition is a shard and
writes segments of whole documents: the ids of its documents in a row, coded by
``simple8b``, with the documents' ids and lengths and the place of the segment
in its shard. Segments are rows of a Parquet table, so the files are committed
by Spark's own protocol on any file system that Spark can write to, and a task
that runs again replaces what it wrote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillmesh.llm.simple8b import decode, encode
from quillmesh.llm.tokens import encoded

#: Ids in a segment before the next document starts another one.
SEGMENT_IDS = 1 << 20


def _segments(path: str, end_id: int):
    def run(batches):
        shard, at, number = TaskContext.get().partitionId(), 0, 0
        for part, ids, counts in encoded(batches, path, end_id):
            ends, first, done = np.cumsum(counts), 0, 0
            while first < len(counts):
                last = max(first + 1, int(np.searchsorted(ends, done + SEGMENT_IDS, "right")))
                data = encode(ids[done : ends[last - 1]])
                docs = part.column("id").slice(first, last - first)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, pa.array(counts[first:last].astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([at + done]), pa.array([int(ends[last - 1] - done)]), *lists, pa.array([data], pa.binary())], names=["shard", "number", "place", "n_ids", "docs", "lengths", "words"])
                first, done, number = last, int(ends[last - 1]), number + 1
            at += done

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, add ``end_id`` to each document and write the files to ``path``.

    Edge cases: a null or empty text is the end id alone; null ids come first;
    rows that repeat an id, null ones too, are documents of their own, in the
    order of a hash of their texts, so they don't share one task; an empty table
    writes a table without rows; other columns are not read. A document longer
    than a segment is a segment of its own.
    """
    kind = docs.schema[id_col].dataType
    schema = StructType([*(StructField(n, LongType()) for n in ("shard", "number", "place", "n_ids")), StructField("docs", ArrayType(kind)), StructField("lengths", ArrayType(LongType())), StructField("words", BinaryType())])
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    ordered.mapInArrow(_segments(tokenizer_path, end_id), schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids`` of every document in the files at ``path``.

    ``start`` counts the ids of all documents before, ``ids`` are little-endian
    unsigned 32-bit integers.

    Edge cases: documents come as they were written, null ids, repeated ids and
    empty texts among them; a table without rows gives none; a document of any
    length is one row.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard, a partition of the writing job: a few MB even for a million of them
    bases = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    kind = segments.schema["docs"].dataType.elementType
    out = StructType([StructField("id", kind), *(StructField(n, LongType()) for n in ("start", "n_tokens")), StructField("ids", BinaryType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = row.column("lengths").flatten().to_numpy()
                flat = decode(row.column("words")[0].as_buffer().to_pybytes()).astype("<u4")
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
                starts = row.column("base")[0].as_py() + row.column("place")[0].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([row.column("docs").flatten(), pa.array(starts), pa.array(counts), ids], names=["id", "start", "n_tokens", "ids"])

    placed = segments.join(F.broadcast(bases), "shard").select("base", "place", "docs", "lengths", "words")
    return placed.mapInArrow(run, out).withColumnRenamed("id", id_col)
