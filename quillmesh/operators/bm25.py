"""BM25 as joins: a stored index of postings with their statistics, asked by many queries at once.

An index is two tables, dealt out by a hash of the term: ``terms`` with the
document counts, and ``blocks``, which hold for each term and range of documents
the postings with their documents' lengths, the largest count and the smallest
length among them. A search reads the buckets of the terms that are asked for,
joins their blocks, and groups what is left; no statistic is counted again.

Documents are dealt into ranges by a hash of their ids, and a range is built where
its texts are. A search for the best documents sends each block of the asked terms
to the task of its range once, whatever number of queries asks for it; the task
adds up the scores of a range as a matrix and only the best of each query leave it.

Where texts are indexed for given queries alone, the index holds the postings of their
terms, with the lengths and the number of all documents: scores are the same, and the
postings of other terms are neither stored nor shuffled.

What a query's terms can add up to in a range is bounded by their blocks' largest
counts and smallest lengths, two numbers a block. A search in two steps is for few
queries of rare terms: the most promising ranges of each query give the score that
has to be reached, and of the other ranges only those are opened whose bound
reaches it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillmesh.functions.text import token_rows
from quillmesh.functions.words import SEARCH_STOP
from quillmesh.workspace import new_path, stored

K1, B, LIMIT = 1.5, 0.75, 50
#: Documents in a range, and postings in a bucket, on average; a posting is taken to have this many bytes of text.
RANGE, BUCKET, POSTING_BYTES = 1024, 1 << 22, 4
#: Ranges that are built, or scored, in a task, bytes of their texts, and queries that are scored together.
TASK_RANGES, TASK_BYTES, QUERIES = 8, 32 << 20, 512
#: Ranges of each query that the first step of a search in two steps opens.
FIRST = 4

_BLOCKS = "term string, range int, n long, max_tf long, min_dl long, tfs long, docs struct<ids:array<{id}>,tfs:array<int>,dls:array<int>>, bucket int"
_DOCS = "array<struct<id:{id},tf:bigint,dl:bigint>>"
#: Runs of ASCII word characters whose terms a task keeps, and those of one text beyond.
KNOWN = 1 << 18
#: Bits that tell the asked terms by a hash; terms that share one with an asked term are stored too.
SLOTS = 1 << 20
#: The bucket of rows without a term, each with the number of tokens of a range.
TOTALS = -1


@dataclass
class Bm25Index:
    """The tables below ``path``, and what a search needs of all documents: their number, the mean of their lengths and the number of ranges and buckets."""

    spark: SparkSession
    path: str
    documents: int
    avgdl: float
    ranges: int
    buckets: int
    id_type: str

    @property
    def terms(self) -> DataFrame:
        """``bucket, term, df, total``."""
        return self.spark.read.schema("term string, df long, total long, bucket int").parquet(f"{self.path}/terms")

    @property
    def lists(self) -> DataFrame:
        """The blocks as they are stored: docs is a list of ids, one of counts and one of lengths."""
        return self._stored_blocks.where(F.col("bucket") != TOTALS)

    @property
    def tokens(self) -> int:
        """The number of tokens of all documents."""
        return self._stored_blocks.where(F.col("bucket") == TOTALS).agg(F.coalesce(F.sum("tfs"), F.lit(0))).first()[0]

    @property
    def _stored_blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS.format(id=self.id_type)).parquet(f"{self.path}/blocks")

    @property
    def blocks(self) -> DataFrame:
        """``bucket, term, range, n, max_tf, min_dl, docs``; docs: ``id, tf, dl``."""
        return self.lists.withColumn("docs", F.arrays_zip("docs.ids", "docs.tfs", "docs.dls").cast(_DOCS.format(id=self.id_type)))

    @property
    def postings(self) -> DataFrame:
        """``id, term, tf, dl``."""
        return self.blocks.select("term", F.inline("docs")).select("id", "term", "tf", "dl")

    @property
    def size(self) -> DataFrame:
        """``n, avgdl``, one row."""
        return self.spark.range(1).select(F.lit(self.documents).cast("long").alias("n"), F.lit(self.avgdl).alias("avgdl"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf`` of every document that has tokens."""
    return token_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text").groupBy("id", "term").agg(F.count("*").alias("tf"))


def _bucket(buckets: int):
    return F.when(F.col("term") == "", F.lit(TOTALS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).alias("bucket")


def _terms_of(token: str) -> tuple[str, ...]:
    """The terms of an identifier, as ``token_rows`` has them."""
    word = token.lower()
    parts = re.split("[_ ]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", token).lower()) if re.search("[a-z0-9][A-Z]|_", token) else []
    return tuple(t for t in (word, *(p for p in parts if p and p != word)) if len(t) >= 2 and t not in _STOP)


_STOP = frozenset(SEARCH_STOP)


#: What separates runs of ASCII word characters, as blanks.
_BETWEEN = bytes(c if chr(c).isascii() and (chr(c).isalnum() or c == 95) else 32 for c in range(256))
_IDENTIFIERS = re.compile("[A-Za-z_][A-Za-z0-9_]*|[0-9]+")


def asked_slots(terms: DataFrame) -> bytes:
    """A bit for the hash of each term; as many bytes whatever the number of terms is."""
    slot = terms.select((F.pmod(F.crc32("term"), F.lit(SLOTS)) + 1).alias("slot"))
    maps = slot.groupBy(F.bitmap_bucket_number("slot").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    # at most SLOTS bits
    found = {n - 1: bytes(bits) for n, bits in maps.collect()}
    return b"".join(found.get(n, bytes(4096)) for n in range(-(-SLOTS // 32768)))


def _in_slots(term: str, asked: bytes) -> bool:
    slot = zlib.crc32(term.encode()) % SLOTS
    return bool(asked[slot >> 3] >> (slot & 7) & 1)


class _Words(dict):
    """The numbers of terms of runs of word characters; ``terms`` has those that are kept, of runs that have any."""

    def __init__(self, asked: bytes | None):
        self.asked, self.terms = asked, {}

    def __missing__(self, word: bytes) -> int:
        if word.isalpha() and word[1:].islower():  # a plain word is its own term
            own = word.decode().lower()
            every = () if own in _STOP else (own,)
        else:
            every = tuple(t for token in _IDENTIFIERS.findall(word.decode()) for t in _terms_of(token))
        kept = every if self.asked is None else tuple(t for t in every if _in_slots(t, self.asked))
        if kept:
            self.terms[word] = kept
        self[word] = len(every)
        return len(every)


def _range_builder(asked: bytes | None = None):
    """Batches of texts in the order of ranges and ids to the blocks of each range, those of ``asked`` terms if given; rows that repeat an id are one document."""

    def flushed(number: int, docs: list[list], kind: pa.DataType) -> pa.RecordBatch:
        codes: dict[str, int] = {}
        sizes = np.array([len(c) for _, _, c in docs], np.int64)
        lengths = np.array([n for _, n, _ in docs], np.int64)
        of_term = np.fromiter((codes.setdefault(t, len(codes)) for _, _, c in docs for t in c), np.int64, sizes.sum())
        tf = np.fromiter((n for _, _, c in docs for n in c.values()), np.int64, sizes.sum())
        at = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(of_term, kind="stable")
        tf, at = tf[order], at[order]
        dl = lengths[at]
        n = np.bincount(of_term, minlength=len(codes))
        begins = np.cumsum(n) - n
        # the last row is the range's own: no term, no document, all its tokens
        offsets = pa.array(np.append(begins, [len(tf), len(tf)]).astype(np.int32))
        listed = lambda values: pa.ListArray.from_arrays(offsets, values)
        ids = pa.array([i for i, _, _ in docs], kind).take(pa.array(at))
        lists = pa.StructArray.from_arrays([listed(ids), listed(pa.array(tf.astype(np.int32))), listed(pa.array(dl.astype(np.int32)))], names=["ids", "tfs", "dls"])
        whole = lambda values, last=0: pa.array(np.append(values, last).astype(np.int64))
        over = lambda f, values: f.reduceat(values, begins) if len(begins) else values
        columns = [pa.array([*codes, ""], pa.string()), pa.array(np.full(len(codes) + 1, number, np.int32)), whole(n), whole(over(np.maximum, tf)), whole(over(np.minimum, dl)), whole(over(np.add, tf), lengths.sum()), lists]
        return pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "max_tf", "min_dl", "tfs", "docs"])

    def run(batches):
        known = _Words(asked)

        def counted(words: list[bytes]) -> tuple[int, dict[str, int]]:
            if len(known) >= KNOWN:
                known.clear()
                known.terms.clear()
            length, out = sum(map(known.__getitem__, words)), {}
            for word, n in Counter(filter(known.terms.__contains__, words)).items():
                for t in known.terms[word]:
                    out[t] = out.get(t, 0) + n
            return length, out

        number, docs, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field("id").type
            for r, i, text in zip(batch.column("range").to_pylist(), batch.column("id").to_pylist(), batch.column("text").cast(pa.binary())):
                if r != number:
                    if docs:
                        yield flushed(number, docs, kind)
                    number, docs = r, []
                length, found = counted((text.as_py() or b"").translate(_BETWEEN).split())
                if docs and docs[-1][0] == i:
                    docs[-1][1] += length
                    for t, n in found.items():
                        docs[-1][2][t] = docs[-1][2].get(t, 0) + n
                elif length:
                    docs.append([i, length, found])
        if docs:
            yield flushed(number, docs, kind)

    return run


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, asked: DataFrame | None = None) -> Bm25Index:
    """An index below ``path``, or in the shared folder: texts are shuffled once, to their ranges, and the blocks that are made of them once, to their buckets.

    With ``asked``, a table with a column ``term``, the index is for these terms: it
    answers them as the whole one does, its blocks stay in the files of the tasks that
    made them, and it holds few other terms.
    """
    spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "bm25")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    documents, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges, buckets = max(1, -(-documents // RANGE)), max(1, -(-size // (POSTING_BYTES * BUCKET)))
    # tasks of a few ranges and texts of a bounded size: neither grows with the table
    tasks = max(min(ranges, spark.sparkContext.defaultParallelism), -(-ranges // TASK_RANGES), min(ranges, -(-size // TASK_BYTES)))
    kind = own.schema["id"].dataType.simpleString()
    ranged = own.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")).repartition(tasks, "range").sortWithinPartitions("range", "id")
    blocks = ranged.mapInArrow(_range_builder(None if asked is None else asked_slots(asked)), _BLOCKS.format(id=kind).removesuffix(", bucket int")).select("*", _bucket(buckets))
    if asked is None:
        _written(blocks, f"{path}/blocks", tasks)
    else:
        blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    index = Bm25Index(spark, path, documents, 1.0, ranges, buckets, kind)
    total = index.tokens
    index.avgdl = float(total / documents if documents and total else 1.0)
    _written(index.lists.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("tfs").alias("total")), f"{path}/terms", buckets)
    # last: an index without this row isn't whole
    row = (documents, index.avgdl, ranges, buckets, index.id_type)
    spark.createDataFrame([row], "documents long, avgdl double, ranges int, buckets int, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
    return index


def _written(rows: DataFrame, path: str, tasks: int) -> None:
    """By buckets and sorted by term, so that a reader of a few terms opens a few files and row groups; a bucket of many rows is several files."""
    # a bucket is written by several tasks, as a frequent term has a block in every range
    dealt = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("term", *(["range"] if "range" in rows.columns else [])), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def save_index(index: Bm25Index, path: str, repo: str, sha: str) -> None:
    """Write an index for a snapshot of a repository; later searches of the snapshot read it."""
    at = f"{path}/repo={repo}/sha={sha}"
    for name, rows in (("blocks", index.lists), ("terms", index.terms)):
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/{name}")
    index.spark.read.parquet(f"{index.path}/size").write.mode("overwrite").parquet(f"{at}/size")


def load_index(spark: SparkSession, path: str, repo: str, sha: str) -> Bm25Index | None:
    """The index of a snapshot; None if there is none, or only a part of one, so another snapshot is never answered from it."""
    at = f"{path}/repo={repo}/sha={sha}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/size/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return Bm25Index(spark, at, *spark.read.parquet(f"{at}/size").select("documents", "avgdl", "ranges", "buckets", "id_type").first())


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, term, qtf`` of every query."""
    rows = token_rows(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("__text")), "__text")
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weighted_terms(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """``query_id, term, bucket, w`` of the terms ``query_id, term, qtf`` that the index has; other buckets aren't read."""
    asked = stored(terms.select("*", _bucket(index.buckets)), "asked")
    # at most as many numbers as the index has buckets
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
    known = index.terms.where(F.col("bucket").isin(wanted)).select(F.col("term").alias("t"), "df")
    n = F.lit(float(index.documents))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    out = asked.join(known, F.col("term") == F.col("t")).select("query_id", "term", "bucket", (idf * (1 + F.log(1 + F.col("qtf")))).alias("w"))
    return stored(out, "weights")


def _part(tf, dl, avgdl: float, k1: float, b: float):
    """What a term of weight 1 adds to the score of a document: more for a larger count, less for a greater length."""
    return tf * (k1 + 1) / F.greatest(tf + k1 * (1 - b + b * dl / avgdl), F.lit(1e-9))


def _asked_blocks(index: Bm25Index, weights: DataFrame, *columns: str) -> DataFrame:
    """The blocks of the asked terms, from their buckets alone, once for each query that asks."""
    wanted = [r[0] for r in weights.select("bucket").distinct().collect()]
    return index.blocks.where(F.col("bucket").isin(wanted)).select("term", "range", *columns).join(weights.drop("bucket"), "term")


def _scored(blocks: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    rows = blocks.select("query_id", "w", F.inline("docs"))
    return rows.groupBy("query_id", "id").agg(F.sum(F.col("w") * _part(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("score"))


def _clamped(k1: float, b: float) -> tuple[float, float]:
    return max(0.1, k1), min(1.0, max(0.0, b))


def scores(index: Bm25Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, id, score`` of every document that shares a term with a query."""
    k1, b = _clamped(k1, b)
    return _scored(_asked_blocks(index, weighted_terms(index, terms), "docs"), index.avgdl, k1, b)


def top(ranked: DataFrame, limit: int = LIMIT, *, key=("query_id",), by=None) -> DataFrame:
    """The best ``limit`` rows of each query with their ``rank``; equal scores, to nine places, by id."""
    order = by or [F.round("score", 9).desc(), F.col("id")]
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= max(1, limit))


def bounds(index: Bm25Index, weights: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, range, bound``: what a document of the range can score at most; reads two numbers of a block."""
    blocks = _asked_blocks(index, weights, "max_tf", "min_dl")
    return blocks.groupBy("query_id", "range").agg(F.sum(F.col("w") * _part(F.col("max_tf"), F.col("min_dl"), index.avgdl, k1, b)).alias("bound"))


def _range_scorer(avgdl: float, k1: float, b: float, limit: int):
    """Batches of blocks, those of a range and of a block of queries one after another, to the ``limit`` best documents of each query there."""

    def flushed(key: tuple, held: list[tuple], least: dict) -> pa.RecordBatch:
        ids = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode(null_encoding="encode")
        names = ids.dictionary
        order = sorted(range(len(names)), key=lambda i, values=names.to_pylist(): (values[i] is not None, values[i]))
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))  # places in the order of ids, so that a stable sort leaves equal scores in it
        at = place[ids.indices.to_numpy(zero_copy_only=False)]
        scores = np.zeros((1 + max(int(h[3].max()) for h in held), len(names)))
        tf, dl = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        parts = tf * (k1 + 1) / np.maximum(tf + k1 * (1 - b + b * dl / avgdl), 1e-9)
        begin = 0
        for docs, _, _, asks, weights in held:
            own, part = at[begin : begin + len(docs)], parts[begin : begin + len(docs)]
            for q, w in zip(asks.tolist(), weights.tolist()):
                scores[q, own] += w * part
            begin += len(docs)
        found: list[tuple] = []
        for q in np.flatnonzero(scores.any(axis=1)).tolist():
            mine = np.flatnonzero(scores[q] > 0)
            rounded = np.round(scores[q, mine], 9)
            # what other ranges of this task have already pushed out
            near = rounded >= least.get((key[0], q), -np.inf) - 2e-9
            mine, rounded = mine[near], rounded[near]
            if len(mine) > limit:
                first = np.argsort(-rounded, kind="stable")
                last = rounded[first[limit - 1]]
                least[key[0], q] = max(last, least.get((key[0], q), -np.inf))
                # another way of rounding may order what comes this close the other way round
                beyond = first[limit:]
                mine = mine[np.concatenate([first[:limit], beyond[(rounded[beyond] < last) & (rounded[beyond] > last - 2e-9)]])]
            found.append((np.full(len(mine), q, np.int32), mine, scores[q, mine]))
        q, at, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        back = np.asarray(order, np.int64)[at.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key[0], np.int32)), pa.array(q.astype(np.int32)), names.take(pa.array(back)), pa.array(s.astype(np.float64))], names=["part", "asks", "id", "score"])

    def run(batches):
        key, held, least = None, [], {}
        for batch in batches:
            lists = [batch.column(n) for n in ("ids", "tfs", "dls", "asking", "weights")]
            begins = [c.offsets.to_pylist() for c in lists]
            values = [c.values if n == 0 else c.values.to_numpy(zero_copy_only=False) for n, c in enumerate(lists)]
            parts, ranges = batch.column("part").to_pylist(), batch.column("range").to_pylist()
            for i in range(batch.num_rows):
                if key != (parts[i], ranges[i]):
                    if held:
                        yield flushed(key, held, least)
                    key, held = (parts[i], ranges[i]), []
                held.append(tuple(v[b[i] : b[i + 1]] for v, b in zip(values, begins)))
        if held:
            yield flushed(key, held, least)

    return run


def _best_of_ranges(index: Bm25Index, weights: DataFrame, limit: int, k1: float, b: float) -> DataFrame:
    """``query_id, id, score``: at least the ``limit`` best documents of every query. A block travels once for a block of queries, and no pair of a query and a document becomes a row."""
    queries = weights.select("query_id").distinct()
    parts = max(1, -(-queries.count() // QUERIES))
    number = F.row_number().over(Window.partitionBy("part").orderBy("query_id")) - 1
    numbers = stored(queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("asks", number), "asking")
    known = weights.join(numbers.withColumnRenamed("query_id", "__q"), F.col("query_id").eqNullSafe(F.col("__q")))
    pairs = known.groupBy("term", "part").agg(F.collect_list(F.struct("asks", "w")).alias("asked"))
    lists = stored(pairs.select("term", "part", F.col("asked.asks").alias("asking"), F.col("asked.w").alias("weights")), "asked-terms")
    wanted = [r[0] for r in weights.select("bucket").distinct().collect()]
    blocks = index.lists.where(F.col("bucket").isin(wanted)).select("term", "range", "docs.ids", "docs.tfs", "docs.dls")
    groups = index.ranges * parts
    tasks = max(min(groups, index.spark.sparkContext.defaultParallelism), -(-groups // TASK_RANGES))
    met = blocks.join(lists, "term").drop("term").repartition(tasks, "part", "range").sortWithinPartitions("part", "range")
    schema = StructType([StructField("part", IntegerType()), StructField("asks", IntegerType()), StructField("id", index.lists.schema["docs"].dataType["ids"].dataType.elementType), StructField("score", DoubleType())])
    found = top(met.mapInArrow(_range_scorer(index.avgdl, k1, b, limit), schema), limit, key=("part", "asks"))
    return found.join(numbers, ["part", "asks"]).select("query_id", "id", "score", "rank")


def best(index: Bm25Index, terms: DataFrame, limit: int = LIMIT, k1: float = K1, b: float = B, pruned: bool = False, first: int = FIRST) -> DataFrame:
    """``query_id, id, score, rank``: the ``limit`` best of ``scores``, stored. With ``pruned``, ranges that can't reach them aren't opened; the rows are the same."""
    k1, b = _clamped(k1, b)
    weights, limit = weighted_terms(index, terms), max(1, limit)
    if not pruned:
        return stored(_best_of_ranges(index, weights, limit, k1, b), "best")
    reach = bounds(index, weights, k1, b)
    placed = stored(reach.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))), "bounds")
    opened = lambda ranges: _scored(_asked_blocks(index, weights, "docs").join(ranges.select("query_id", "range"), ["query_id", "range"]), index.avgdl, k1, b).where("score > 0")
    early = stored(top(opened(placed.where(F.col("n") <= first)), limit), "first-ranges")
    least = early.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    # equal scores are ordered by id after rounding, so what comes close is opened too
    late = placed.where(F.col("n") > first).join(least, "query_id", "left").where(F.col("bound") > F.coalesce(F.col("least"), F.lit(0.0)) - 1e-8)
    return top(early.drop("rank").unionByName(opened(late)), limit)


def bm25_search(docs: DataFrame | Bm25Index, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, limit: int = LIMIT) -> DataFrame:
    """``query_id, id, score, rank``: the best documents of every query; ``docs`` can be an index that was built before."""
    if isinstance(docs, Bm25Index):
        return best(docs, query_terms(queries, query_id, query_text), limit)
    # read twice
    terms = stored(query_terms(queries, query_id, query_text), "query-terms")
    return best(build_index(docs, doc_id, doc_text, asked=terms), terms, limit)
