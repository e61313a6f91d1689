"""Dense search in bulk: blocks of vectors times blocks of queries.

Vectors are packed into rows of many, each with the matrix of its block, and
queries likewise. A pair of blocks is one matrix product inside a task, of which
the best of each query leave it; ranks over all rows are merged by a window.
Lengths are taken once for a block, and no pair of a vector and a query becomes
a row.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from quillmesh.functions.vectors import cosine
from quillmesh.operators.bm25 import top
from quillmesh.workspace import stored

#: Bytes of queries up to which they are sent to every task; beyond, they meet the vectors in blocks.
SENT_BYTES = 64 << 20
#: Vectors and queries in a block; a product of two blocks has some 8 MB.
VECTORS, QUERIES = 4096, 256
#: The same for sign bits, of which a product of two blocks has some 16 MB.
CODES, CODE_QUERIES = 32768, 64
#: Places to which scores are rounded before they are ordered.
PLACES = 9


def packed(rows: DataFrame, id_col: str, vector_col: str, size: int, marks: str | None = None) -> DataFrame:
    """``ids, dims, m``: rows of up to ``size`` vectors of one length, as a matrix of doubles; rows without a vector are left out.

    ``marks`` names a column that is kept as a list with a value for each id.
    """
    schema = StructType([StructField("ids", ArrayType(rows.schema[id_col].dataType)), StructField("dims", LongType()), StructField("m", BinaryType())])
    if marks:
        schema = schema.add("marks", ArrayType(rows.schema[marks].dataType))

    def block(held: list, dims: int) -> pa.RecordBatch:
        ids, flat, extra = (pa.concat_arrays([h[i] for h in held]) for i in range(3)) if marks else (*(pa.concat_arrays([h[i] for h in held]) for i in range(2)), None)
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [whole(ids), pa.array([dims], pa.int64()), pa.array([np.asarray(flat, np.float64).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, whole(extra)] if marks else columns, names=schema.names)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                for at in range(0, part.num_rows, size):
                    cut = part.slice(at, size)
                    mine = held.setdefault(dims, [])
                    mine.append((cut.column("id"), cut.column("v").flatten(), cut.column("marks") if marks else None))
                    if sum(len(h[0]) for h in mine) >= size:
                        yield block(held.pop(dims), dims)
        for dims, mine in held.items():
            yield block(mine, dims)

    columns = [F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *([F.col(marks).alias("marks")] if marks else [])]
    return rows.select(*columns).mapInArrow(run, schema)


def paired(rows: DataFrame, asked: DataFrame, size: int, row_key: str, asked_key: str) -> DataFrame:
    """Every row of ``asked``, of ``size`` bytes together, with every one of ``rows``: exact search against all rows.

    What asks goes to every task if it is measured to be small. If it isn't, it
    is dealt into blocks and the rows into salts, and each block meets each salt
    in a task of its own.
    """
    if size <= SENT_BYTES:
        return rows.crossJoin(F.broadcast(asked))
    blocks = -(-size // SENT_BYTES)
    salts = -(-4 * rows.sparkSession.sparkContext.defaultParallelism // blocks)
    spread = lambda k, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias(name)
    dealt = asked.withColumn("__block", F.pmod(F.xxhash64(asked_key), F.lit(blocks))).select("*", spread(salts, "__salt"))
    # every row once in each block, in one of its salts: blocks times salts tasks of about one split of rows each
    return rows.withColumn("__salt", F.pmod(F.xxhash64(row_key), F.lit(salts))).select("*", spread(blocks, "__block")).join(dealt, ["__block", "__salt"]).drop("__block", "__salt")


def _crossed(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of queries with every block of vectors."""
    q = stored(queries.select(F.col("ids").alias("qids"), F.col("dims").alias("qdims"), F.col("m").alias("qm"), *(["marks"] if "marks" in queries.columns else [])), "asked-blocks")
    size = q.agg(F.coalesce(F.sum(F.length("qm") + 64 * F.size("qids")), F.lit(0))).first()[0]
    return paired(vectors, q, size, "ids", "qids")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _scores(row: dict) -> np.ndarray:
    """Cosines of all queries of a row with all its vectors, over the places that both have."""
    dims = min(row["dims"], row["qdims"])
    side = lambda m, n: _unit(np.frombuffer(m, np.float64).reshape(-1, n)[:, :dims]) if n else np.zeros((0, 0))
    if not dims:
        return np.zeros((len(row["qids"]), len(row["ids"])))
    return np.round(side(row["qm"], row["qdims"]) @ side(row["m"], row["dims"]).T, PLACES) + 0.0


def cosine_search(vectors: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """``query_id, id, score, rank``: the largest cosines, equal ones by id. vectors: ``id, v``; queries: ``query_id, q``.

    Vectors of different lengths are compared over the places that both have; a
    vector without length scores 0.
    """
    kinds = (queries.schema["query_id"].dataType, vectors.schema["id"].dataType)
    schema = StructType([StructField("query_id", kinds[0]), StructField("id", kinds[1]), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("ids", "dims", "m", "qids", "qdims", "qm")}
                s, ids = _scores(row), row["ids"]
                order = sorted(range(len(ids)), key=ids.__getitem__)  # so that a stable sort leaves equal scores in the order of ids
                best = np.argsort(-s[:, order], axis=1, kind="stable")[:, :limit] if len(ids) else np.zeros((len(s), 0), int)
                of, at = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["qids"][k] for k in of], batch.schema.field("qids").type.value_type), pa.array([ids[order[k]] for k in at], batch.schema.field("ids").type.value_type), pa.array(s[of, np.asarray(order, int)[at]] if len(at) else [], pa.float64()),
                ], names=["query_id", "id", "score"])

    pairs = _crossed(packed(vectors, "id", "v", VECTORS), packed(queries, "query_id", "q", QUERIES))
    return top(pairs.mapInArrow(run, schema), limit)


def hamming_best(codes: DataFrame, queries: DataFrame, limit: int, words: int) -> DataFrame:
    """``query_id, id, dist``: of every block of codes, the nearest to each query, then by id. codes: ``id, bits``; queries: ``query_id, qbits``, words of 32 bits.

    A code that lacks one of the first ``words`` words has no distance, and comes first.
    """
    kinds = (queries.schema["query_id"].dataType, codes.schema["id"].dataType)
    schema = StructType([StructField("query_id", kinds[0]), StructField("id", kinds[1]), StructField("dist", IntegerType())])
    side = lambda m, n: np.frombuffer(m, np.float64).reshape(-1, n)[:, :words].astype(np.uint64)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dims", "m", "qdims", "qm")}
                ids, qids = batch.column("ids")[i].values, batch.column("qids")[i].values
                names = ids.to_pylist()
                order = np.array(sorted(range(len(names)), key=lambda k, own=names: (own[k] is not None, own[k])), np.int64)
                dist = np.full((len(qids), len(names)), 0 if min(row["dims"], row["qdims"]) >= words else -1, np.int16)
                if min(row["dims"], row["qdims"]) >= words:
                    m, q = side(row["m"], row["dims"])[order], side(row["qm"], row["qdims"])
                    for w in range(words):
                        dist += np.bitwise_count(q[:, w, None] ^ m[None, :, w])
                best = np.argsort(dist, axis=1, kind="stable")[:, :limit]
                of, at = np.repeat(np.arange(len(dist)), best.shape[1]), best.ravel()
                found = dist[of, at].astype(np.int32)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), ids.take(pa.array(order[at])), pa.array(found, mask=found < 0)], names=["query_id", "id", "dist"])

    return _crossed(packed(codes, "id", "bits", CODES), packed(queries, "query_id", "qbits", CODE_QUERIES)).mapInArrow(run, schema)


def cosine_ranks(vectors: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``query_id, id, rank``: where the rows of ``wanted`` (``query_id, id``) stand among all vectors, without sorting these.

    The scores of the wanted rows come first; a product of all blocks then counts
    what lies before each: a number for each wanted row and block.
    """
    asked = wanted.join(queries, "query_id").join(vectors, "id")
    mark = F.struct((-F.round(cosine(F.col("v"), F.col("q")), PLACES)).alias("s"), F.col("id").alias("id"))
    marked = asked.groupBy("query_id").agg(F.first("q").alias("q"), F.array_sort(F.collect_set(mark)).alias("marks"))
    kinds = (queries.schema["query_id"].dataType, vectors.schema["id"].dataType)
    schema = StructType([StructField("query_id", kinds[0]), StructField("id", kinds[1]), StructField("before", LongType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("ids", "dims", "m", "qids", "qdims", "qm", "marks")}
                s = _scores(row)
                order = sorted(range(len(row["ids"])), key=row["ids"].__getitem__)
                ids = [row["ids"][k] for k in order]
                out: list[tuple] = []
                for q, marks, mine in zip(row["qids"], row["marks"], s[:, order]):
                    rising = np.sort(mine)
                    for m in marks:
                        equal = np.flatnonzero(mine == -m["s"])
                        smaller = int(np.searchsorted(equal, bisect_left(ids, m["id"])))
                        out.append((q, m["id"], len(rising) - int(np.searchsorted(rising, -m["s"], "right")) + smaller))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("qids").type.value_type), pa.array([o[1] for o in out], batch.schema.field("ids").type.value_type), pa.array([o[2] for o in out], pa.int64())], names=["query_id", "id", "before"])

    pairs = _crossed(packed(vectors, "id", "v", VECTORS), packed(marked, "query_id", "q", QUERIES, "marks"))
    return pairs.mapInArrow(run, schema).groupBy("query_id", "id").agg((F.sum("before") + 1).cast("int").alias("rank"))
