"""Packing documents into fixed windows by concatenating and cutting.

Pass one encodes every document once and stores the ids with the number of the
partition that wrote them and the place within it, and sums up the tokens of
each partition. A prefix sum over those totals, one row for each partition,
gives every partition its global offset. Pass two cuts each document at the
multiples of the window length: a piece belongs to window offset // length, and
a document that crosses windows leaves a boundary record in each of them. All
windows but the last are full, so padding is less than one window in all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmesh.llm.tokens import encoded
from quillmesh.workspace import stored


#: Distinct words that a worker remembers here; in a pipeline it shares its executor with what earlier stages have left.
CACHED_WORDS = 250_000


def _tokenised(path: str, end_id: int, out_schema: pa.Schema):
    def run(batches):
        part, at, row = TaskContext.get().partitionId(), 0, 0
        for batch, ids, counts in encoded(batches, path, end_id, cached_words=CACHED_WORDS):
            ends = np.cumsum(counts)
            small = ids.astype("<u2" if len(ids) == 0 or ids.max() < 65536 else "<u4")
            width = small.dtype.itemsize
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(small.tobytes())])
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), pa.array(at + ends - counts), pa.array(counts.astype(np.int64)), pa.array(np.full(n, width)), column], schema=out_schema
            )
            at, row = at + int(ends[-1]), row + n

    return run


def _cut(length: int, out_schema: pa.Schema):
    def run(batches):
        for batch in batches:
            starts, counts = batch.column("place").to_numpy(), batch.column("doc_tokens").to_numpy()
            first, last = starts // length, (starts + counts - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(counts)), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(starts[doc], sequence * length)
            end = np.minimum(starts[doc] + counts[doc], (sequence + 1) * length)
            ids = [np.frombuffer(x.as_buffer(), f"<u{w.as_py()}").astype("<u4") for x, w in zip(batch.column("ids"), batch.column("width"))]
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")  # pieces of the documents in order are the ids in order
            offsets = np.concatenate([[0], np.cumsum(end - begin) * 4]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), *(pa.array(x) for x in (begin - starts[doc], end - begin, counts[doc], sequence, begin - sequence * length)), column], schema=out_schema
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = 1024) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is its ids and then ``end_id``. ``start`` is where the piece
    begins in its document, ``offset`` where it begins in its sequence, and
    ``ids`` its ids as little-endian unsigned 32-bit integers.

    Edge cases: a null or empty text is the end id alone; null ids and rows that
    repeat an id are documents of their own; an empty table gives no rows;
    other columns are not read. Documents follow each other as the table's
    partitions hold them, and pass two reads what pass one has stored, so a
    task that runs again writes the same pieces.
    """
    id_field = StructField("id", docs.schema[id_col].dataType, True)
    schema = StructType([id_field]).add("part", "long").add("row", "long").add("local", "long").add("doc_tokens", "long").add("width", "long").add("ids", "binary")
    arrow_id = pa.field("id", _arrow_type(docs, id_col))
    longs = lambda *names: [pa.field(n, pa.int64()) for n in names]
    tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_tokenised(tokenizer_path, end_id, pa.schema([arrow_id, *longs("part", "row", "local", "doc_tokens", "width"), pa.field("ids", pa.binary())])), schema)
    tokens = stored(tokens, "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("words"))
    bases = totals.select("part", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # one row for each partition of pass one: a table of a few MB even for millions of them
    placed = tokens.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.col("local")).alias("place"), "doc_tokens", "width", "ids")
    out = StructType([id_field, *(StructField(n, LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset"))]).add("ids", "binary")
    pieces = placed.mapInArrow(_cut(length, pa.schema([arrow_id, *longs("start", "length", "doc_tokens", "sequence_id", "offset"), pa.field("ids", pa.binary())])), out)
    return pieces.withColumnRenamed("id", id_col)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, ids, boundaries`` (the pieces' offsets, in order).

    Edge cases: what ``pack`` gives for null or empty texts, null or repeated ids
    and texts of any length are pieces like others; a sequence holds 1,024 ids at
    most; no pieces make no sequences; other columns are not read.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("boundaries"))
