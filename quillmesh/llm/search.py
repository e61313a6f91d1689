"""Ranked lexical search, a document at a time.

An index is cut into shards of neighbouring rows. A shard numbers its documents
in the order of their ids and holds, for each term, the sorted list of its
documents with the term's occurrences, as differences in variable-length bytes.
A search reads the lists of the terms that are asked for. In each shard the
lists of an item are merged by a heap, a document at a time; a heap of the best,
by score and then by id, bounds what is kept. Lists of frequent terms that can't
lift a document over the worst of the best on their own aren't merged, only
looked into by binary search; this loses nothing. The shards' best are merged by
rank over all.

Sizes and counts that a score needs come from all documents: their number,
their length, and in how many of them a term is.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.tokens import steps
from quillmesh.workspace import new_path

#: Bytes of text in a shard; bounds what a task holds while it indexes and searches.
SHARD_BYTES = 16 << 20
#: Items that are searched for together.
BLOCK = 1024
#: ASCII letters in lower case and digits stay, other ASCII characters part terms.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SCHEMA = "shard long, term string, df long, ordinals binary, counts binary, docs long, words long, ids array<{id}>, lengths array<long>"


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of numbers, each in as many bytes of seven bits as it needs; list i ends before ``ends[i]``."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1) << np.uint64(7 * k)
    last = np.cumsum(width)
    out = np.zeros(int(last[-1]) if len(last) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        on = width > k
        more = (width[on] > k + 1).astype(np.uint8) << 7
        out[last[on] - width[on] + k] = (values[on] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    offsets = np.concatenate([[0], last])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of one list of ``packed``."""
    b = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], b[:-1] < 128])) if len(b) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first) if len(b) else first


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TERMS).split()


def _shard(ids: list, texts: list, number: int, kind: pa.DataType) -> pa.RecordBatch:
    """The rows of one shard: one with its documents, then one for each term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    names: dict[bytes, int] = {}
    each = [np.fromiter((names.setdefault(t, len(names)) for t in terms_of(texts[i] or b"")), np.int64) for i in order]
    lengths, n = np.array([len(x) for x in each], np.int64), len(order)
    key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *each]) * max(n, 1) + np.repeat(np.arange(n), lengths), return_counts=True)
    term, doc = np.divmod(key, max(n, 1))
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    step = np.diff(doc, prepend=0)
    step[starts] = doc[starts]
    ends = np.append(starts[1:], len(term)) if len(term) else starts
    m = len(names)
    head = lambda value, type_: pa.concat_arrays([pa.array([value], type_), pa.nulls(m, type_)])
    rest = lambda values, type_: pa.concat_arrays([pa.nulls(1, type_), values.cast(type_)])
    columns = [
        pa.array(np.full(m + 1, number)), rest(pa.array(list(names), pa.binary()), pa.string()), rest(pa.array(ends - starts), pa.int64()), rest(packed(step, ends), pa.binary()), rest(packed(count, ends), pa.binary()),
        head(int((lengths > 0).sum()), pa.int64()), head(int(lengths.sum()), pa.int64()), head([ids[i] for i in order], pa.list_(kind)), head(lengths.tolist(), pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "ordinals", "counts", "docs", "words", "ids", "lengths"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write the shards of all rows of ``docs`` to ``path``, as a Parquet table.

    Edge cases: a null or empty text has no terms and is never found; a null id
    stands after all others; rows that repeat an id are documents of their own;
    an empty table makes an empty index; other columns are not read.
    """

    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in steps(batch, "text", shard_bytes):
                size = part.column("text").cast(pa.binary()).nbytes
                if ids and held + size > shard_bytes:
                    yield _shard(ids, texts, number, kind)
                    number, ids, texts, held = number + 1, [], [], 0
                ids += part.column("id").to_pylist()
                texts += part.column("text").cast(pa.binary()).to_pylist()
                held += size
        if ids:
            yield _shard(ids, texts, number, kind)

    schema = _SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def best(lists: list[tuple[list[int], list[int], int, int]], most: int) -> list[tuple[int, int]]:
    """The ``most`` best ``(score, document)`` above 0, of equal scores the smaller documents.

    lists: the documents of a term in ascending order, what it adds to their
    scores, the largest of that, and its ``most``-th largest (0 if it has fewer).
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists]).tolist()  # the most that a list and the ones before it can add
    limit, kept, passive = max([0, *(x[3] - 1 for x in lists)]), [], 0  # what has to be exceeded
    while passive < len(lists) and reach[passive] <= limit:
        passive += 1
    heads = [(docs[0], i, 0) for i, (docs, *_) in enumerate(lists) if i >= passive]
    heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            _, i, at = heads[0]
            docs, adds = lists[i][0], lists[i][1]
            score += adds[at]
            if at + 1 < len(docs) and i >= passive:
                heapreplace(heads, (docs[at + 1], i, at + 1))
            else:
                heappop(heads)
        for i in range(passive - 1, -1, -1):
            if score + reach[i] <= limit:
                break
            docs = lists[i][0]
            at = bisect_left(docs, doc)
            if at < len(docs) and docs[at] == doc:
                score += lists[i][1][at]
        if score > limit:
            heappush(kept, (score, -doc))
            if len(kept) > most:
                heappop(kept)
            if len(kept) == most and kept[0][0] > limit:
                limit, before = kept[0][0], passive
                while passive < len(lists) and reach[passive] <= limit:
                    passive += 1
                if passive > before:  # lists that became passive leave the merge
                    heads = [h for h in heads if h[1] >= passive]
                    heapify(heads)
    return [(score, -doc) for score, doc in kept]


def search(index: DataFrame, items: DataFrame, most: int = 50, item_col: str = "item_id", text_col: str = "text", id_name: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The ``most`` best documents of each item: ``item_col, rank, id_name, score``, equal scores by ascending id.

    Edge cases: an item without terms, or whose terms no document holds, has no
    rows; a null item is one of its own; rows that repeat an item's id are one
    item with the terms of all; null ids of documents come last among equal
    scores; an empty index or table of items gives no rows.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.struct(F.col(item_col).alias("id")).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(_TERM), F.lit(0)))).alias("term")).distinct()
    blocks = -(-items.select(item_col).distinct().count() // block) or 1
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    spark, heads = index.sparkSession, index.where("term is null")
    n, total = heads.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    path = new_path(spark, "hits")
    index.where("term is not null").select("shard", "term", "df", "ordinals", "counts").join(terms.select("term").distinct(), "term", "left_semi").write.parquet(path)
    hits = spark.read.parquet(path)
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("d") + 1).cast("double")))
    weights = hits.groupBy("term").agg(F.sum("df").alias("d")).select("term", weight.alias("w"))
    asked = terms.groupBy("block", "term").agg(F.collect_list("item").alias("items")).join(weights, "term").where("w > 0").select(F.col("term").alias("t"), "block", "items", "w")
    rows = hits.join(asked, F.col("term") == F.col("t")).select("shard", "block", "w", "ordinals", "counts", "items")
    m = F.expr(f"transform(lengths, x -> 50L + (50L * x * {n}L) div {max(total, 1)}L)")
    shards = heads.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "ids", m.alias("m"))
    item_type, id_type = items.schema[item_col].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[frame["m"].notna()]
        out: list[tuple] = []
        if len(head) and len(head) < len(frame):
            ids, length = head["ids"].iloc[0], 20 * np.asarray(head["m"].iloc[0], np.int64)
            by_item: dict = {}
            for w, ordinals, counts, who in frame[frame["m"].isna()][["w", "ordinals", "counts", "items"]].itertuples(index=False):
                docs, tf = np.cumsum(unpacked(ordinals)), unpacked(counts)
                adds = int(w) * (1_000_000_000 * tf // (1000 * tf + length[docs]))
                kth = int(np.partition(adds, -most)[-most]) if len(adds) >= most else 0
                listed = (docs.tolist(), adds.tolist(), int(adds.max()), kth)
                for item in who:
                    by_item.setdefault(item["id"], []).append(listed)
            for item, lists in by_item.items():
                out += ((item, ids[doc], score) for score, doc in best(lists, most))
        return pd.DataFrame({c: pd.Series([o[i] for o in out], dtype=object) for i, c in enumerate(("item", "doc", "score"))})

    every = rows.unionByName(shards, allowMissingColumns=True)
    found = every.groupBy("shard", "block").applyInPandas(merged, f"item {item_type}, doc {id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_name), "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 50, **options) -> DataFrame:
    """``search`` in an index of ``docs`` that is written to the shared folder first."""
    path = new_path(docs.sparkSession, "search-index")
    build_index(docs, path)
    return search(read_index(docs.sparkSession, path), items, most, **options)
