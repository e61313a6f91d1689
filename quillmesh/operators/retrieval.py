"""Dense search, fusion of ranked lists, reranking, and their compositions, for many queries at once.

Rows are ``query_id, id, score``; the order inside a list is an explicit rank.
Ids come first and texts last: only ids and scores are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import query_symbols, trimmed, words
from quillmesh.functions.vectors import binarized, cosine, doubles
from quillmesh.operators import bm25
from quillmesh.operators.bm25 import top
from quillmesh.operators.dense import cosine_ranks, cosine_search, hamming_best
from quillmesh.workspace import stored

COARSE, RRF_K = 50, 60
VECTOR_WEIGHT = 0.7

def hamming_search(vectors: DataFrame, queries: DataFrame, limit: int = COARSE, dims: int = 64) -> DataFrame:
    """``query_id, id, dist, score, rank``: nearest sign bits first, then by id. vectors: ``id, bits``; queries: ``query_id, qbits``."""
    rows = hamming_best(vectors, queries, max(1, limit), -(-dims // 32))
    return top(rows.withColumn("score", 1 / (1 + F.col("dist"))), limit, by=[F.col("dist"), F.col("id")])


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists ``query_id, id, rank``: ``query_id, id, score`` with the rank in each list as ``r0, r1...``.

    Equal sums keep the order of the first list that has the document.
    """
    tagged = reduce(DataFrame.unionByName, (x.select("query_id", "id", F.col("rank").alias("r"), F.lit(i).alias("l")) for i, x in enumerate(lists)))
    ranks = [F.min(F.when(F.col("l") == i, F.col("r"))).alias(f"r{i}") for i in range(len(lists))]
    fused = tagged.groupBy("query_id", "id").agg(*ranks)
    # a sum in the lists' order, so that equal ranks give equal numbers
    parts = [F.coalesce(1 / (k + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(lists))]
    return fused.withColumn("score", reduce(lambda a, b: a + b, parts))


def fused_order(n: int) -> list:
    """The order of a fused list: by score, then as the lists have it."""
    first = reduce(lambda a, b: F.coalesce(a, b), [F.col(f"r{i}") + i * 1_000_000_000 for i in range(n)])
    return [F.round("score", 12).desc(), first, F.col("id")]


def expand_with_graph(candidates: DataFrame, edges: DataFrame, seeds: int = 20, weight: float = 0.5) -> DataFrame:
    """Candidates and, behind them, the neighbours of the first ``seeds`` at ``weight`` of the best seed's score.

    candidates: ``query_id, id, score, rank``; edges: ``id, neighbour``. Every
    row also has ``expanded`` and its ``place``: the rank of a candidate, and for
    a neighbour a number behind all ranks, in the order of the seeds. A
    neighbour that is a candidate already stays as it is.
    """
    near = candidates.where(F.col("rank") <= seeds).join(edges, "id").groupBy("query_id", F.col("neighbour").alias("id")).agg((F.max("score") * weight).alias("score"), F.min("rank").alias("seed"))
    new = near.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    own = candidates.select("query_id", "id", "score", F.lit(False).alias("expanded"), F.col("rank").cast("long").alias("place"))
    return own.unionByName(new.select("query_id", "id", "score", F.lit(True).alias("expanded"), (F.col("seed") + 1_000_000_000).alias("place")))


def blend(expanded: DataFrame, vectors: DataFrame, queries: DataFrame, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Rerank: ``weight`` of the cosine and the rest of the fused score over the query's largest one. vectors: ``id, v``; queries: ``query_id, q``."""
    largest = F.max("score").over(Window.partitionBy("query_id"))
    prior = F.when(largest > 0, F.col("score") / largest).otherwise(F.lit(0.0))
    rows = expanded.withColumn("prior", prior).join(vectors.select("id", "v"), "id").join(queries.select("query_id", "q"), "query_id")
    return rows.select("query_id", "id", (weight * cosine(F.col("v"), F.col("q")) + (1 - weight) * F.col("prior")).alias("score"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, edges: DataFrame | None = None, limit: int = 5, coarse: int = COARSE, dims: int = 64, quantised: bool = True, keywords: bool = True, rerank: bool = True, index: bm25.Bm25Index | None = None) -> DataFrame:
    """``query_id, id, score, rank``: sign bits and BM25, fused, expanded over the graph, reranked by the cosine.

    chunks: ``id, text, v``; queries: ``query_id, text, q``. The switches give
    the configurations that an ablation compares: without ``quantised`` the
    cosines of all chunks are ranked in place of the nearest sign bits, without
    ``keywords`` the nearest sign bits are ordered by the cosine alone, and
    without ``rerank`` the order is that of the fused scores, then of the fused
    list. ``index`` is a BM25 index of the chunks that was built before.
    """
    vectors = chunks.select("id", "v", binarized(F.col("v")).alias("bits"))
    asked = queries.select("query_id", "q", binarized(F.col("q")).alias("qbits"))
    found = bm25.bm25_search(index or chunks, queries, "id", "text", "query_id", "text", coarse) if keywords else None
    if quantised:
        dense = hamming_search(vectors, asked, coarse, dims)
    else:
        # all ranks count, but only those of the first and of what the keywords find can come to the top
        dense = cosine_search(vectors, asked, coarse).select("query_id", "id", "rank")
        if keywords:
            found = stored(found, "keywords")
            ranks = cosine_ranks(vectors, asked.select("query_id", "q"), found.select("query_id", "id"))
            dense = dense.unionByName(ranks.join(dense, ["query_id", "id"], "left_anti").select(dense.columns))
    if not keywords:
        return top(blend(dense.select("query_id", "id", F.lit(1.0).alias("score")), vectors, asked, 1.0), limit)
    # some rows a query, stored so that what they are joined with isn't shuffled
    fused = stored(top(fuse(dense, found), coarse, by=fused_order(2)), "fused")
    expanded = expand_with_graph(fused, edges) if edges is not None else fused.withColumn("place", F.col("rank").cast("long"))
    if not rerank:
        return top(expanded.select("query_id", "id", "score", "place"), limit, by=[F.round("score", 12).desc(), F.col("place"), F.col("id")]).drop("place")
    return top(blend(expanded.select("query_id", "id", "score"), vectors, asked), limit)


def distinct_variants(variants: DataFrame) -> DataFrame:
    """The variants of every query without white space around them; empty ones and repetitions of an earlier one go, and the rest are numbered from 0."""
    own = variants.withColumn("text", trimmed(F.col("text"))).where(F.length("text") > 0)
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("variant"))).where("__n = 1").drop("__n")
    return first.withColumn("variant", F.row_number().over(Window.partitionBy("query_id").orderBy("variant")) - 1)


def multipath_search(chunks: DataFrame, variants: DataFrame, limit: int = 5, coarse: int = COARSE, dims: int = 64, edges: DataFrame | None = None, index: bm25.Bm25Index | None = None, alpha: float = 0.7, shown: DataFrame | None = None) -> DataFrame:
    """Hybrid search of every variant of a query in one job, fused over the variants, then ranked by preference.

    variants: ``query_id, variant, text, q``. Variants are trimmed, and empty and
    repeated ones left out. What the paths of several variants find is fused by
    its ranks and scored by the cosine to the first variant; the results of an
    only variant keep their scores. Preference takes the symbols of all variants,
    the chunks' ``name`` and their files' ``definitions`` where ``chunks`` has
    these columns. ``shown`` gives these and the text where ``chunks`` is a join,
    so that only what was found is looked up.
    """
    own = stored(distinct_variants(variants), "variants")
    several = own.groupBy("query_id").agg((F.count("*") > 1).alias("several"))
    keyed = own.select(F.struct("query_id", "variant").alias("query_id"), "text", "q")
    paths = hybrid_search(chunks, keyed, edges, max(2 * limit, 10), coarse, dims, index=index)
    ranks = stored(paths.select("query_id.query_id", "query_id.variant", "id", "score", "rank").join(several, "query_id"), "paths")
    fused = ranks.where("several").groupBy("query_id", "id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("variant", "rank")).alias("first"))
    kept = stored(top(fused, coarse, by=[F.round("score", 12).desc(), F.col("first"), F.col("id")]), "kept")
    first = own.where("variant = 0").select("query_id", "q")
    scored = kept.select("query_id", "id", "rank").join(chunks.select("id", "v"), "id").join(first, "query_id").select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score"), "rank")
    single = ranks.where(~F.col("several") & (F.col("rank") <= limit)).select("query_id", "id", "score", "rank")
    symbols = own.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(query_symbols(F.col("text"))))).alias("symbols"))
    named = {"name": F.lit(None).cast("string"), "definitions": F.lit(None).cast("array<string>")}
    texts = chunks if shown is None else shown
    shown = texts.select("id", F.col("text").alias("code"), *(F.col(c) if c in texts.columns else v.alias(c) for c, v in named.items()))
    results = stored(scored.unionByName(single), "scored").join(symbols, "query_id").join(shown, "id")
    return preference_rerank(results, limit, alpha)


def keyword_search(docs: DataFrame, queries: DataFrame, limit: int = COARSE) -> DataFrame:
    """``query_id, id, score, rank``: how often the query's symbols occur as whole words; a symbol that is asked twice counts twice."""
    found = docs.select("id", F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word")).where("word is not null")
    occurrences = found.groupBy("id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    asked = queries.select("query_id", F.explode(query_symbols(F.col("text"), distinct=False)).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("asked"))
    return top(occurrences.join(asked, "word").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("asked")).alias("score")), limit)


def preference(symbols, name, definitions, mentioned) -> "F.Column":
    """How well a chunk fits the query's symbols, from 0 to 1: half for a definition, half for the part of the symbols that its words mention.

    ``mentioned``: the words of the chunk, as ``functions.text.words`` gives them.
    """
    defined = F.when(F.array_contains(symbols, F.lower(name)), F.lit(1.0)).when(F.exists(F.coalesce(definitions, F.array().cast("array<string>")), lambda d: F.array_contains(symbols, F.lower(d)) & F.array_contains(mentioned, F.lower(d))), F.lit(0.6)).otherwise(F.lit(0.0))
    ratio = F.size(F.array_intersect(symbols, mentioned)) / F.size(symbols)
    return F.when(F.size(symbols) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.5 * F.coalesce(defined, F.lit(0.0)) + 0.5 * ratio))


def preference_rerank(results: DataFrame, limit: int = 5, alpha: float = 0.7) -> DataFrame:
    """``query_id, id, score, rank``; without symbols the order stays. results: ``query_id, id, score, rank, symbols, name, definitions, code``.

    A chunk that many queries found is cut into words once.
    """
    rows = stored(results, "found")
    cut = rows.groupBy("id").agg(F.first("code").alias("code")).select("id", F.array_distinct(words(F.col("code"))).alias("mentioned"))
    mixed = F.when(F.size("symbols") == 0, F.col("score")).otherwise(alpha * F.col("score") + (1 - alpha) * preference(F.col("symbols"), F.col("name"), F.col("definitions"), F.col("mentioned")))
    rows = rows.drop("code").join(cut, "id").withColumn("old", F.col("rank")).withColumn("score", mixed)
    order = [F.when(F.size("symbols") == 0, F.lit(0.0)).otherwise(-F.round("score", 9)), F.col("old")]
    return top(rows, limit, by=order).select("query_id", "id", "score", "rank")


def merge_refined(first: DataFrame, second: DataFrame, limit: int = 8) -> DataFrame:
    """The best of two result lists: every document at its larger score."""
    return top(first.select("query_id", "id", "score").unionByName(second.select("query_id", "id", "score")).groupBy("query_id", "id").agg(F.max("score").alias("score")), limit)


def needs_refinement(results: DataFrame, queries: DataFrame, least: float = 0.4) -> DataFrame:
    """``query_id, weak``: fewer than two results, or none that scores well."""
    best = results.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) < 2).__or__(F.coalesce("best", F.lit(0.0)) < least).alias("weak"))


def inject_baseline(results: DataFrame, wanted: DataFrame, chunks: DataFrame, most: int = 2) -> DataFrame:
    """For overview queries, the first chunk of up to two of the usual introductory files that are not among the results, at score 0.

    results: ``query_id, id, file, score``; wanted: ``query_id``; chunks: ``id, file, ord``.
    """
    usual = F.array(*map(F.lit, ("readme.md", "README.md", "README", "package.json")))  # fixed values, in order
    heads = chunks.where(F.array_contains(usual, F.col("file"))).groupBy("file").agg(F.min_by("id", "ord").alias("id")).withColumn("prio", F.array_position(usual, F.col("file")))
    # at most four rows: one for each of the usual names
    new = wanted.crossJoin(F.broadcast(heads)).join(results.select("query_id", "file").distinct(), ["query_id", "file"], "left_anti")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("prio"))).where(F.col("n") <= most)
    return results.unionByName(new.select("query_id", "id", "file", F.lit(0.0).alias("score")))


def claim_evidence(answers: DataFrame, chunks: DataFrame, embed, most: int = 3, each: int = 2, chars: int = 300, dims: int = 64, index: bm25.Bm25Index | None = None) -> DataFrame:
    """``answer_id, claim, evidence``: what the corpus says to the first claims of every answer, all in one search.

    answers: ``answer_id, claims``; chunks: ``id, file, text, v``; ``embed`` makes a vector column of a text column.
    """
    claims = answers.select("answer_id", F.posexplode(F.slice("claims", 1, most)).alias("n", "claim"))
    asked = claims.select(F.struct("answer_id", "n").alias("query_id"), F.col("claim").alias("text"), embed("claim").alias("q"))
    found = stored(hybrid_search(chunks, asked, limit=each, dims=dims, index=index), "proof").join(chunks.select("id", "file", F.substring("text", 1, chars).alias("shown")), "id")
    line = F.concat(F.lit("File: "), "file", F.lit("\n```\n"), "shown", F.lit("\n```"))
    joined = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("evidence"))
    return claims.join(joined.select("query_id.answer_id", "query_id.n", "evidence"), ["answer_id", "n"]).select("answer_id", "claim", "evidence")


def embed_chunks(chunks: DataFrame, embed, text_col: str = "text", as_: str = "v") -> DataFrame:
    """``chunks`` with a vector for each, of its code alone; ``embed`` is a column function such as ``functions.models.embedding`` makes."""
    return chunks.withColumn(as_, embed(F.col(text_col)))


def with_vectors(df: DataFrame, id_col: str, vector_col: str, id_as: str, as_: str) -> DataFrame:
    return df.select(F.col(id_col).alias(id_as), doubles(F.col(vector_col)).alias(as_))
