"""Queries of search, fusion and reranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import sql
from quillmesh.functions.models import HashEmbedder, StubClient, completion, embedding
from quillmesh.functions.text import evidence_terms, query_symbols
from quillmesh.functions.vectors import binarized, l2_normalized
from quillmesh.functions.words import SEARCH_STOP, sql_list
from quillmesh.operators import ask as ask_operator
from quillmesh.operators import bm25, evaluation, evidence, retrieval
from quillmesh.operators.hamming_tables import table_search
from quillmesh.plans.tables import chunks, documents, numbered, table, text_index, text_queries, texts, vector_queries, vectors
from quillmesh.workspace import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def tokens_sql(source: str, id_col: str, text: str = "text") -> str:
    """Rows ``id, term`` of the search tokens of a table."""
    return f"""
SELECT {id_col} AS id, lower(u) AS term FROM (
  SELECT {id_col}, unnest(list_concat([t], list_filter(
    string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_ ]+'),
    lambda p: p <> '' AND lower(p) <> lower(t)))) AS u
  FROM (SELECT {id_col}, unnest(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS t FROM {source}))
WHERE length(u) >= 2 AND lower(u) NOT IN ({sql_list(SEARCH_STOP)})"""


def bm25_sql(docs: str, id_col: str, queries: str, query_id: str, limit: int, p: str = "") -> str:
    """CTEs that end in ``{p}bm25(query_id, id, score, rank)``."""
    return f"""
{p}tok AS ({tokens_sql(docs, id_col)}),
{p}post AS (SELECT id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}dl AS (SELECT d_.{id_col} AS id, coalesce(n, 0) AS dl FROM {docs} d_ LEFT JOIN (SELECT id, count(*) AS n FROM {p}tok GROUP BY id) x ON x.id = d_.{id_col}),
{p}size AS (SELECT count(*) AS n, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM {p}dl),
{p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}q AS (SELECT id AS query_id, term, count(*) AS qtf FROM ({tokens_sql(queries, query_id)}) GROUP BY ALL),
{p}score AS (
  SELECT q.query_id, t.id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (1 + ln(1 + qtf)) * tf * 2.5::DOUBLE
    / greatest(tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl), 1e-9::DOUBLE)) AS score
  FROM {p}q q JOIN {p}post t USING (term) JOIN {p}df USING (term) JOIN {p}dl d ON d.id = t.id, {p}size GROUP BY ALL),
{p}bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {p}score WHERE score > 0 QUALIFY rank <= {limit})"""


COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def bits_sql(v: str) -> str:
    """The 64 sign bits of a vector as two numbers."""
    word = lambda g: f"list_sum(list_transform(range(0, 32), lambda i: CASE WHEN {v}[{g} * 32 + i + 1] > 0 THEN (1::BIGINT << i::INTEGER) ELSE 0 END))::BIGINT"
    return f"{word(0)} AS w0, {word(1)} AS w1"


DENSE = f"""
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, {bits_sql('embedding')} FROM embeddings)"""
HAMMING = "(bit_count(xor({a}.w0, {b}.w0)) + bit_count(xor({a}.w1, {b}.w1)))::BIGINT"


def dense_sql(store: str, asked: str, limit: int = 50, name: str = "ham") -> str:
    dist = HAMMING.format(a="s", b="a")
    return f"""
{name} AS (SELECT a.query_id, s.id, {dist} AS dist, row_number() OVER (PARTITION BY a.query_id ORDER BY {dist}, s.id) AS rank
  FROM {store} s, {asked} a QUALIFY rank <= {limit})"""


def cos_sql(store: str, asked: str, limit: int = 50, name: str = "cosine") -> str:
    return f"""
{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT a.query_id, s.id, {COS.format(a='s.v', b='a.v')} AS score FROM {store} s, {asked} a) QUALIFY rank <= {limit})"""


def fuse_sql(a: str, b: str, limit: int = 50, name: str = "fused") -> str:
    return f"""
{name} AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS rank FROM (
    SELECT query_id, id, coalesce(1::DOUBLE / (60 + r0), 0) + coalesce(1::DOUBLE / (60 + r1), 0) AS score, coalesce(r0, r1 + 1000000000) AS first
    FROM (SELECT query_id, id, min(r) FILTER (l = 0) AS r0, min(r) FILTER (l = 1) AS r1 FROM (
      SELECT query_id, id, rank AS r, 0 AS l FROM {a} UNION ALL SELECT query_id, id, rank, 1 FROM {b}) GROUP BY ALL))
  QUALIFY rank <= {limit})"""


ASKED = "asked AS (SELECT id AS query_id, v, label, w0, w1 FROM vec WHERE id % 100 = 0)"


@query(f"SELECT id AS doc_id, term, count(*) AS tf FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY ALL")
def tokenize_terms(spark, sf_dir):
    return bm25.term_counts(texts(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"SELECT id AS doc_id, term, count(*) AS tf FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY ALL")
def sql_terms(spark, sf_dir):
    """The terms of documents by the functions that SQL has, in SQL."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, c.term, CAST(c.tf AS BIGINT) AS tf FROM (SELECT doc_id, code_tokens(text) AS tokens FROM {docs}), LATERAL term_counts(tokens) c", docs=documents(spark, sf_dir))


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, {bits_sql('embedding')} FROM embeddings), z AS (SELECT * FROM v ORDER BY vec_id LIMIT 1)
SELECT v.vec_id, round({COS.format(a='v.v', b='z.v')}, 6) AS cosine, (bit_count(xor(v.w0, z.w0)) + bit_count(xor(v.w1, z.w1)))::BIGINT AS hamming FROM v, z""")
def sql_vectors(spark, sf_dir):
    """Every vector against the first one, in SQL."""
    sql.register(spark)
    first = vectors(spark, sf_dir).orderBy("id").limit(1)
    return spark.sql("SELECT v.id AS vec_id, round(cosine(v.v, z.v), 6) AS cosine, CAST(hamming(sign_bits(v.v), sign_bits(z.v)) AS BIGINT) AS hamming FROM {v} v CROSS JOIN {z} z", v=vectors(spark, sf_dir), z=first)


@query(f"""
WITH t AS (SELECT id, term, count(*) AS tf FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM documents) AS n, round((SELECT sum(tf) FROM t)::DOUBLE / (SELECT count(*) FROM documents), 6) AS avgdl)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, n, avgdl FROM t, s GROUP BY term, n, avgdl""")
def bm25_index_stats(spark, sf_dir):
    index = bm25.build_index(texts(spark, sf_dir), "doc_id", "text")
    return index.terms.crossJoin(F.broadcast(index.size)).select("term", "df", "total", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 50)} SELECT query_id AS item_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_topk(spark, sf_dir):
    found = bm25.bm25_search(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""
WITH occ AS (SELECT doc_id, lower(w) AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS w FROM documents) GROUP BY ALL),
asked AS (SELECT item_id, lower(w) AS word, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][A-Za-z0-9_]+')) AS w FROM benchmark)
  WHERE lower(w) NOT IN ({sql_list(SEARCH_STOP)}) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(n * k)::BIGINT AS score FROM occ JOIN asked USING (word) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50""")
def keyword_match(spark, sf_dir):
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword_search(docs, asked).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT vec_id, i AS pos, round(CASE WHEN n > 0 THEN v[i] / n ELSE v[i] END, 6) AS x FROM (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(l2_normalized(F.col("v"))).alias("pos", "x"))
    return v.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, {bits_sql('embedding')} FROM embeddings")
def binarize_words(spark, sf_dir):
    bits = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), binarized(F.col("v")).alias("bits"))
    return bits.select("vec_id", F.col("bits")[0].alias("w0"), F.col("bits")[1].alias("w1"))


def _dense(spark, sf_dir, quantised):
    v, q = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    if quantised:
        return retrieval.hamming_search(v.select("id", binarized(F.col("v")).alias("bits")), q.select("query_id", binarized(F.col("q")).alias("qbits")))
    return retrieval.cosine_search(v, q)


@query(f"WITH {DENSE}, {ASKED}, {dense_sql('vec', 'asked')} SELECT query_id, id AS vec_id, dist, rank FROM ham")
def hamming_topk(spark, sf_dir):
    return _dense(spark, sf_dir, True).select("query_id", F.col("id").alias("vec_id"), F.col("dist").cast("long").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DENSE}, {ASKED}, {dense_sql('vec', 'asked', 1)} SELECT query_id, id AS vec_id, dist, rank FROM ham")
def hamming_tables(spark, sf_dir):
    """The nearest code of every asked one, out of tables of segments."""
    v, q = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    found = table_search(v.select("id", binarized(F.col("v")).alias("bits")), q.select("query_id", binarized(F.col("q")).alias("qbits")), 1)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("dist").cast("long").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DENSE}, {ASKED}, {cos_sql('vec', 'asked')} SELECT query_id, id AS vec_id, round(score, 6) AS score, rank FROM cosine")
def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, False).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DENSE}, {ASKED}, {dense_sql('vec', 'asked')}, {cos_sql('vec', 'asked')}, {fuse_sql('ham', 'cosine', 1000)} SELECT query_id, id AS vec_id, round(score, 9) AS score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    fused = retrieval.top(retrieval.fuse(_dense(spark, sf_dir, True), _dense(spark, sf_dir, False)), 1000, by=retrieval.fused_order(2))
    return fused.select("query_id", F.col("id").alias("vec_id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


STORE = f"""{DENSE},
n_vec AS (SELECT count(*) AS nv FROM vec),
store AS (SELECT d.doc_id AS id, d.text, d.source, v.v, v.w0, v.w1 FROM documents d CROSS JOIN n_vec JOIN vec v ON v.id = d.doc_id % nv),
asked AS (SELECT b.item_id AS query_id, b.text, v.v, v.w0, v.w1 FROM benchmark b CROSS JOIN n_vec JOIN vec v ON v.id = b.item_id % nv)"""
HYBRID = f"""{STORE}, {bm25_sql('store', 'id', 'asked', 'query_id', 50)}, {dense_sql('store', 'asked')}, {fuse_sql('ham', 'bm25')},
blended AS (SELECT f.query_id, f.id, 0.7::DOUBLE * {COS.format(a='s.v', b='a.v')} + (1::DOUBLE - 0.7::DOUBLE) * (f.score / max(f.score) OVER (PARTITION BY f.query_id)) AS score
  FROM fused f JOIN store s ON s.id = f.id JOIN asked a ON a.query_id = f.query_id),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM blended QUALIFY rank <= 10)"""


@query(f"WITH {HYBRID} SELECT query_id AS item_id, id AS doc_id, round(score, 6) AS score, rank FROM hybrid WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    found = retrieval.hybrid_search(chunks(spark, sf_dir), text_queries(spark, sf_dir), index=text_index(spark, sf_dir))
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SYMBOLS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: t NOT IN ({sql_list(SEARCH_STOP)})))"
WORDS = "list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9_]+'), lambda w: lower(w))"
DEFINED = r"list_transform(regexp_extract_all(coalesce({}, ''), '(?m)^([A-Za-z_][A-Za-z0-9_]+)', 1), lambda w: lower(w))"
PREFERENCE = """CASE WHEN len(symbols) = 0 THEN score ELSE 0.7::DOUBLE * score + (1::DOUBLE - 0.7::DOUBLE) *
  least(1, 0.5::DOUBLE * (CASE WHEN list_contains(symbols, lower(source)) THEN 1::DOUBLE WHEN len(list_intersect(list_intersect(symbols, defined), words)) > 0 THEN 0.6::DOUBLE ELSE 0 END)
    + 0.5::DOUBLE * (len(list_intersect(symbols, words))::DOUBLE / len(symbols))) END"""


def defined(rows):
    """Documents as files: their source is the name, and the words that begin their lines are what they define."""
    return rows.withColumns({"name": F.col("source"), "definitions": F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?m)^([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1))})


def several_sql(variants: str, limit: int, coarse: int = 50, name: str = "several", p: str = "") -> str:
    """CTEs that end in ``{name}(query_id, id, score, rank)``: every variant's hybrid search, fused, and ranked by preference. variants: ``query_id, variant, text, v, w0, w1``."""
    return f"""
{p}trimmed AS (SELECT * REPLACE (trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text) FROM {variants}),
{p}own AS (SELECT query_id AS q, text, v, w0, w1, row_number() OVER (PARTITION BY query_id ORDER BY variant) - 1 AS variant, count(*) OVER (PARTITION BY query_id) AS n
  FROM (SELECT * FROM {p}trimmed WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY variant) = 1)),
{p}keyed AS (SELECT q * 1000 + variant AS query_id, text, v, w0, w1 FROM {p}own),
{bm25_sql('store', 'id', f'{p}keyed', 'query_id', coarse, p)}, {dense_sql('store', f'{p}keyed', coarse, f'{p}ham')}, {fuse_sql(f'{p}ham', f'{p}bm25', coarse, f'{p}fused')},
{p}blended AS (SELECT f.query_id, f.id, 0.7::DOUBLE * {COS.format(a='s.v', b='a.v')} + (1::DOUBLE - 0.7::DOUBLE) * (f.score / max(f.score) OVER (PARTITION BY f.query_id)) AS score
  FROM {p}fused f JOIN store s ON s.id = f.id JOIN {p}keyed a ON a.query_id = f.query_id),
{p}paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {p}blended) WHERE rank <= {max(2 * limit, 10)}),
{p}merged AS (SELECT query_id // 1000 AS query_id, id, sum(1::DOUBLE / (60 + rank)) AS score, min((query_id % 1000) * 1000 + rank) AS first FROM {p}paths GROUP BY ALL),
{p}kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS rank FROM {p}merged) WHERE rank <= {coarse}),
{p}found AS (
  SELECT k.query_id, k.id, {COS.format(a='s.v', b='o.v')} AS score, k.rank FROM {p}kept k JOIN store s ON s.id = k.id JOIN {p}own o ON o.q = k.query_id AND o.variant = 0 AND o.n > 1
  UNION ALL SELECT q, id, score, rank FROM {p}paths JOIN {p}own ON q * 1000 = query_id AND n = 1 WHERE rank <= {limit}),
{p}sym AS (SELECT q, list_distinct(flatten(list({SYMBOLS}))) AS symbols FROM {p}own GROUP BY q),
{p}shown AS (SELECT f.*, symbols, s.source, {DEFINED.format('s.text')} AS defined, {WORDS.format('s.text')} AS words FROM {p}found f JOIN {p}sym ON q = query_id JOIN store s ON s.id = f.id),
{p}mixed AS (SELECT query_id, id, rank AS old, len(symbols) AS n, {PREFERENCE} AS score FROM {p}shown),
{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 0 THEN 0 ELSE -round(score, 9) END, old) AS rank FROM {p}mixed) WHERE rank <= {limit})"""


@query(f"""
WITH {STORE},
variants AS (
  SELECT query_id, 0 AS variant, text, v, w0, w1 FROM asked UNION ALL
  SELECT a.query_id, 1, CASE WHEN a.query_id % 4 = 0 THEN ' ' || a.text ELSE substr(a.text, 1, (length(a.text) // 2)::BIGINT) END, n.v, n.w0, n.w1 FROM asked a CROSS JOIN n_vec JOIN vec n ON n.id = (a.query_id + 1) % nv),
{several_sql('variants', 5)}
SELECT query_id AS item_id, id AS doc_id, round(score, 6) AS score, rank FROM several""")
def multipath_search(spark, sf_dir):
    """Every passage and its first half as two phrasings; for a quarter of the passages the second is the first again."""
    asked = text_queries(spark, sf_dir)
    half = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit(" "), "text")).otherwise(F.expr("substring(text, 1, int(length(text) / 2))"))
    second = numbered(spark, sf_dir, asked.select("query_id", (F.col("query_id") + 1).alias("after"), half.alias("text")), "after").select("query_id", "text", F.col("v").alias("q"))
    variants = asked.withColumn("variant", F.lit(0)).unionByName(second.withColumn("variant", F.lit(1)))
    shown = defined(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source"))
    found = retrieval.multipath_search(chunks(spark, sf_dir), variants, index=text_index(spark, sf_dir), shown=shown)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH seeds AS (SELECT o_orderkey AS id, o_custkey, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20),
near AS (SELECT o.o_orderkey AS id, max(s.score) * 0.5::DOUBLE AS score FROM seeds s JOIN orders o ON o.o_custkey = s.o_custkey WHERE o.o_orderkey NOT IN (SELECT id FROM seeds) GROUP BY ALL)
SELECT id, round(score::DOUBLE, 6) AS score, false AS expanded FROM seeds UNION ALL SELECT id, round(score::DOUBLE, 6), true FROM near""")
def graph_expand(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").cast("double").alias("score"))
    seeds = retrieval.top(orders.withColumn("query_id", F.lit(0)), 20, by=[F.col("score").desc(), F.col("id")])
    # the edges of the seeds only: orders of the same customer
    edges = seeds.select(F.col("id"), "o_custkey").join(orders.select(F.col("id").alias("neighbour"), "o_custkey"), "o_custkey").select("id", "neighbour")
    return retrieval.expand_with_graph(seeds.select("query_id", "id", "score", "rank"), edges).select("id", F.round("score", 6).alias("score"), "expanded")


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 50)},
sym AS (SELECT item_id, {SYMBOLS} AS symbols FROM benchmark),
rows AS (SELECT b.query_id, b.id, b.score, b.rank, symbols, d.source, {DEFINED.format('d.text')} AS defined, {WORDS.format('d.text')} AS words
  FROM bm25 b JOIN sym ON item_id = query_id JOIN documents d ON d.doc_id = b.id),
mixed AS (SELECT query_id, id, rank AS old, len(symbols) AS n, {PREFERENCE} AS score FROM rows)
SELECT query_id AS item_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 0 THEN 0 ELSE -round(score, 9) END, old) AS rank FROM mixed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 0 THEN 0 ELSE -round(score, 9) END, old) <= 5""")
def preference_rerank(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    found = bm25.bm25_search(texts(spark, sf_dir), items, "doc_id", "text", "item_id", "text")
    rows = found.join(items.select(F.col("item_id").alias("query_id"), query_symbols(F.col("text")).alias("symbols")), "query_id")
    rows = rows.join(defined(documents(spark, sf_dir)).select(F.col("doc_id").alias("id"), "name", "definitions", F.col("text").alias("code")), "id")
    ranked = retrieval.preference_rerank(rows)
    return ranked.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {HYBRID}, {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 5, 'k_')},
both_ AS (SELECT query_id, id, score FROM hybrid WHERE rank <= 5 UNION ALL SELECT query_id, id, score FROM k_bm25),
best AS (SELECT query_id, id, max(score) AS score FROM both_ GROUP BY ALL)
SELECT query_id AS item_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM best QUALIFY rank <= 8""")
def merge_refined(spark, sf_dir):
    # one index for both searches, unless documents lack a vector
    index = text_index(spark, sf_dir)
    first = retrieval.hybrid_search(chunks(spark, sf_dir), text_queries(spark, sf_dir), index=index)
    second = bm25.bm25_search(index if index.documents == documents(spark, sf_dir).count() else texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 5)
    return retrieval.merge_refined(first, second).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {HYBRID}, b AS (SELECT query_id, count(*) AS n, max(score) AS best FROM hybrid WHERE rank <= 5 GROUP BY ALL)
SELECT item_id, coalesce(n, 0) < 2 OR coalesce(best, 0) < 0.4 AS weak FROM benchmark LEFT JOIN b ON query_id = item_id""")
def refinement_flag(spark, sf_dir):
    found = retrieval.hybrid_search(chunks(spark, sf_dir), text_queries(spark, sf_dir), index=text_index(spark, sf_dir))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return retrieval.needs_refinement(found, items).withColumnRenamed("query_id", "item_id")


METRICS = """
rel AS (SELECT a.query_id, v.id FROM asked a JOIN vec v ON v.label = a.label AND v.id <> a.query_id),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL)"""


def _metrics_sql(run: str, config: str) -> str:
    return f"""
SELECT '{config}' AS config, q.query_id, round(coalesce(count(rel.id) FILTER (r.rank <= 5) / any_value(n)::DOUBLE, 0), 6) AS recall,
  round(coalesce(1::DOUBLE / min(r.rank) FILTER (rel.id IS NOT NULL), 0), 6) AS mrr,
  round(coalesce(sum(1::DOUBLE / log2(r.rank + 1)) FILTER (rel.id IS NOT NULL AND r.rank <= 10), 0) / coalesce(any_value(ideal), 1), 6) AS ndcg
FROM asked q LEFT JOIN {run} r ON r.query_id = q.query_id LEFT JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id
  LEFT JOIN n ON n.query_id = q.query_id
  LEFT JOIN (SELECT query_id, sum(1::DOUBLE / log2(i + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(n, 10)::BIGINT + 1)) AS i FROM n) GROUP BY ALL) i ON i.query_id = q.query_id
GROUP BY q.query_id"""


def _qrels(spark, sf_dir):
    asked, store = vector_queries(spark, sf_dir), vectors(spark, sf_dir)
    return asked.select("query_id", "label").join(store.select("id", "label"), "label").where("id <> query_id").select("query_id", "id", F.lit(1).alias("relevance"))


def _runs(spark, sf_dir):
    ham, cosine = _dense(spark, sf_dir, True), _dense(spark, sf_dir, False)
    fused = retrieval.top(retrieval.fuse(ham, cosine), 50, by=retrieval.fused_order(2))
    runs = [x.select(F.lit(c).alias("config"), "query_id", "id", "rank") for c, x in (("quantised", ham), ("exact", cosine), ("fused", fused))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


_RUNS = f"WITH {DENSE}, {ASKED}, {dense_sql('vec', 'asked')}, {cos_sql('vec', 'asked')}, {fuse_sql('ham', 'cosine')}, {METRICS}, each_ AS ({_metrics_sql('ham', 'quantised')} UNION ALL {_metrics_sql('cosine', 'exact')} UNION ALL {_metrics_sql('fused', 'fused')})"


@query(f"{_RUNS} SELECT * FROM each_")
def ir_metrics(spark, sf_dir):
    each = evaluation.metrics(_runs(spark, sf_dir), _qrels(spark, sf_dir), vector_queries(spark, sf_dir).select("query_id"), ("config",))
    return each.select("config", "query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query(f"{_RUNS} SELECT config, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM each_ GROUP BY config")
def ablation_summary(spark, sf_dir):
    each = ir_metrics(spark, sf_dir)
    return each.groupBy("config").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 5).alias(c) for c in ("recall", "mrr", "ndcg")))


@query()
def ask(spark, sf_dir):
    """Every benchmark passage as a question, with the stand-ins of a model and of an embedder."""
    embed = embedding(lambda: HashEmbedder(64))
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("source").alias("name"), F.lit("text_chunk").alias("node_type"), "text")
    store = stored(retrieval.embed_chunks(rows, embed), "embedded")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    replies = completion(lambda: StubClient({"Answer from": "The code says so in its files.", "numbered": "1. The code says so in its files."}))
    return ask_operator.ask(store, questions, embed, replies).withColumnRenamed("query_id", "item_id")


from quillmesh.functions.words import EVIDENCE_STOP  # noqa: E402

TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._/-]+'), lambda t: length(t) >= 3 AND t NOT IN ({sql_list(EVIDENCE_STOP)})))"
# DuckDB's list_distinct has no order: the first place of each term gives it
TERM_ROWS = f"""
raw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._/-]+') AS l FROM benchmark),
pos AS (SELECT item_id, t, min(i) AS i FROM (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM raw) WHERE length(t) >= 3 AND t NOT IN ({sql_list(EVIDENCE_STOP)}) GROUP BY ALL),
term AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM pos QUALIFY n <= 12),
res AS (SELECT b.query_id AS item_id, b.id AS doc_id, b.score, lower(d.source || chr(10) || coalesce(d.text, '')) AS hay, lower(d.source) AS file FROM bm25 b JOIN documents d ON d.doc_id = b.id)"""
EVIDENCE = f"WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 10)}, {TERM_ROWS}"


def _found(spark, sf_dir):
    """The ten best documents of every passage."""
    return bm25.bm25_search(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 10)


def _results(spark, sf_dir):
    """The ten best documents of every passage, with their texts."""
    docs, found = documents(spark, sf_dir), _found(spark, sf_dir)
    # ten rows a query, which the queries below read more than once
    return stored(found.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("text").alias("code")), "id"), "results")


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), evidence_terms(F.col("text")).alias("terms"))


@query(f"""{EVIDENCE}
SELECT t.item_id, count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS missing, round(coalesce(any_value(best), 0), 6) AS best FROM (
  SELECT term.item_id, t, coalesce(bool_or(contains(hay, t)), false) AS m FROM term LEFT JOIN res USING (item_id) GROUP BY ALL) t
LEFT JOIN (SELECT item_id, max(score) AS best FROM res GROUP BY ALL) b ON b.item_id = t.item_id GROUP BY t.item_id""")
def evidence_coverage(spark, sf_dir):
    out = evidence.coverage(_terms(spark, sf_dir), _results(spark, sf_dir)).where(F.size("terms") > 0)
    return out.select(F.col("query_id").alias("item_id"), F.size("matched").cast("long").alias("matched"), F.size("missing").cast("long").alias("missing"), F.round("best", 6).alias("best"))


@query(f"""{EVIDENCE},
hit AS (SELECT item_id, doc_id, any_value(score) AS score, bool_or(contains(hay, t)) AS h FROM res LEFT JOIN term USING (item_id) WHERE score > 0 GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score FROM hit QUALIFY coalesce(h, false) OR NOT bool_or(coalesce(h, false)) OVER (PARTITION BY item_id)""")
def grounded_citations(spark, sf_dir):
    out = evidence.grounded(_results(spark, sf_dir), _terms(spark, sf_dir))
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""{EVIDENCE},
ans AS (SELECT item_id, lower(text) AS answer FROM benchmark),
hits AS (SELECT item_id, doc_id, score, file, count(*) FILTER (contains(hay, t) AND n <= 6) AS q, count(*) FILTER (contains(hay, t)) AS a FROM res JOIN term USING (item_id) GROUP BY ALL),
c AS (SELECT hits.*, contains(answer, file) AS m, a * 3 + q + (CASE WHEN contains(answer, file) THEN 4 ELSE 0 END) + least(2, score * 2) AS correlation FROM hits JOIN ans USING (item_id) WHERE score > 0)
SELECT item_id, doc_id, round(correlation, 6) AS correlation, row_number() OVER (PARTITION BY item_id ORDER BY round(correlation, 9) DESC, round(score, 9) DESC, doc_id) AS rank
FROM c WHERE m OR a > 0 OR (q >= 2 AND score >= 0.55)""")
def correlated_citations(spark, sf_dir):
    terms = _terms(spark, sf_dir).select("query_id", F.slice("terms", 1, 6).alias("query_terms"), F.col("terms").alias("answer_terms")).where(F.size("answer_terms") > 0)
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("answer"))
    out = evidence.correlated(_results(spark, sf_dir), terms.join(answers, "query_id"))
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("correlation", 6).alias("correlation"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 50)}
SELECT item_id, file, first_line, last_line, round(score, 6) AS score, n, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, file) AS rank
FROM (SELECT query_id AS item_id, source AS file, min(id) AS first_line, max(id) AS last_line, max(score) AS score, count(*) AS n
  FROM bm25 JOIN documents ON doc_id = id GROUP BY query_id, source) QUALIFY rank <= 6""")
def citations_by_file(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = bm25.bm25_search(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    rows = found.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file")), "id").withColumns({"start_line": F.col("id"), "end_line": F.col("id")})
    out = evidence.by_file(rows)
    return out.select(F.col("query_id").alias("item_id"), "file", "first_line", "last_line", F.round("score", 6).alias("score"), "n", F.col("rank").cast("long").alias("rank"))
