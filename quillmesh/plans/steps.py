"""Queries of single steps around search: imports, judgements, addresses, introductions, safe results, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import evaluation, extract, paths, retrieval, safety, summaries
from quillmesh.plans.corpus import PAGE_SEARCH, SQL_PATTERNS, _injected, _with_orders, page_index_search
from quillmesh.plans.retrieval import COS, HYBRID, _found, _metrics_sql, _results, bm25_sql, cos_sql, defined, fuse_sql, several_sql
from quillmesh.plans.tables import chunks, documents, numbered, table, text_index, text_queries
from quillmesh.sources.index_store import pending
from quillmesh.workspace import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("""
WITH f AS (SELECT doc_id, coalesce(lang, 'xx') AS dir, 'src/' || coalesce(lang, 'xx') || '/m' || doc_id AS base, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.js' END AS ext FROM documents),
i AS (SELECT 'src/' || dir || '/m' || doc_id AS file, './m' || (doc_id + 7) AS import, 'src/' || dir || '/m' || (doc_id + 7) AS base, false AS bare FROM f UNION ALL
  SELECT 'src/' || dir || '/m' || doc_id, '../en/x/../m' || (doc_id + 1), 'src/en/m' || (doc_id + 1), false FROM f UNION ALL
  SELECT 'src/' || dir || '/m' || doc_id, 'm' || (doc_id * 2), 'm' || (doc_id * 2), true FROM f)
SELECT i.file || f0.ext AS file, import, f.base || f.ext AS target FROM i JOIN f f0 ON f0.base = i.file
JOIN f ON CASE WHEN bare THEN f.base = 'src/' || f.dir || '/' || i.base AND f.ext <> '/index.js' ELSE f.base = i.base END""")
def import_resolution(spark, sf_dir):
    """Documents as modules that import each other: beside, above, and by a bare name."""
    ext = F.when(F.col("doc_id") % 3 == 0, ".ts").when(F.col("doc_id") % 3 == 1, ".js").otherwise("/index.js")
    lang = F.coalesce("lang", F.lit("xx"))
    files = documents(spark, sf_dir).select(F.lit("repo").alias("repo"), F.concat(F.lit("src/"), lang, F.lit("/m"), F.col("doc_id").cast("string"), ext).alias("path"), "doc_id")
    folder = F.when(F.col("doc_id") % 3 == 2, "../").otherwise("./")  # an index lies one folder deeper
    own = lambda c: F.concat(folder, F.lit("m"), c.cast("string"))
    above = F.concat(F.when(F.col("doc_id") % 3 == 2, "../").otherwise(""), F.lit("../en/x/../m"), (F.col("doc_id") + 1).cast("string"))
    each = F.explode(F.array(*(F.struct(a.alias("import"), b.alias("shown")) for a, b in (
        (own(F.col("doc_id") + 7), F.concat(F.lit("./m"), (F.col("doc_id") + 7).cast("string"))), (above, F.concat(F.lit("../en/x/../m"), (F.col("doc_id") + 1).cast("string"))),
        (F.concat(F.lit("m"), (F.col("doc_id") * 2).cast("string")), F.concat(F.lit("m"), (F.col("doc_id") * 2).cast("string")))))))
    imports = files.select("repo", F.col("path").alias("file"), each.alias("i")).select("repo", "file", "i.import", "i.shown")
    found = extract.resolve_imports(imports.select("repo", "file", "import"), files.select("repo", "path"))
    return found.join(imports, ["repo", "file", "import"]).select("file", F.col("shown").alias("import"), "target")


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 10)},
c AS (SELECT doc_id AS id, CASE doc_id % 50 WHEN 0 THEN 'README.md' WHEN 1 THEN 'package.json' WHEN 2 THEN 'readme.md' ELSE source END AS file FROM documents),
r AS (SELECT query_id, c.id, file, score FROM bm25 JOIN c USING (id)),
h AS (SELECT file, min(id) AS id, CASE file WHEN 'readme.md' THEN 1 WHEN 'README.md' THEN 2 ELSE 4 END AS prio FROM c WHERE file IN ('readme.md', 'README.md', 'README', 'package.json') GROUP BY file),
n AS (SELECT q.query_id, h.id, h.file FROM (SELECT item_id AS query_id FROM benchmark) q, h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = q.query_id AND r.file = h.file)
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY prio) <= 2)
SELECT query_id AS item_id, id AS doc_id, file, round(score, 6) AS score FROM r UNION ALL SELECT query_id, id, file, 0 FROM n""")
def baseline_context(spark, sf_dir):
    """Every benchmark passage as a question for an overview."""
    k = F.col("doc_id") % 50
    chunks = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(k == 0, "README.md").when(k == 1, "package.json").when(k == 2, "readme.md").otherwise(F.col("source")).alias("file"), F.col("doc_id").alias("ord"))
    found = _found(spark, sf_dir).select("query_id", "id", "score").join(chunks.select("id", "file"), "id").select("query_id", "id", "file", "score")
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    out = retrieval.inject_baseline(found, wanted, chunks)
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "file", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT source AS query_id, doc_id AS id, max(CASE WHEN quality = 1 THEN 2 ELSE 1 END) AS relevance FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY ALL),
n AS (SELECT d.source AS query_id, d.doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = d.source AND q.id = d.doc_id)
  QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY md5('neg:' || d.source || ':' || d.doc_id), d.doc_id) <= 5)
SELECT query_id AS source, id AS doc_id, relevance::BIGINT AS relevance FROM q UNION ALL SELECT query_id, id, 0 FROM n""")
def relevance_judgements(spark, sf_dir):
    """Sources as queries: good documents are relevant, others a little, and some that weren't judged are negatives."""
    docs = documents(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "lang").where("query_id is not null")
    judged = docs.where("lang = 'en'").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    qrels = evaluation.graded_qrels(judged.where("quality = 1"), judged)
    negatives = evaluation.hard_negatives(qrels, docs.select("query_id", "id"), 5)
    out = qrels.select("query_id", "id", "relevance").unionByName(negatives)
    return out.select(F.col("query_id").alias("source"), F.col("id").alias("doc_id"), F.col("relevance").cast("long").alias("relevance"))


@query("""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, (doc_id % 4 + 1)::INTEGER AS a, (doc_id % 4 + 1 + doc_id % 3)::INTEGER AS b, coalesce(source, '-') AS source FROM documents),
s AS (SELECT *, array_to_string(list_slice(string_split(text, chr(10)), a, b), chr(10)) AS span FROM u)
SELECT doc_id, 'o' || doc_id % 9 AS owner, 'r' AS repo, 'v' || doc_id % 3 AS ref, 'src/' || source || '.py' AS path, a::BIGINT AS first_line, b::BIGINT AS last_line,
  CASE WHEN length(span) >= 30 THEN md5(substr(span, 1, 2000)) END AS span_md5 FROM s""")
def blob_lines(spark, sf_dir):
    """The lines of documents that addresses of files at a revision name."""
    d = documents(spark, sf_dir)
    a, b = (F.col("doc_id") % 4 + 1), (F.col("doc_id") % 4 + 1 + F.col("doc_id") % 3)
    url = F.concat(F.lit("see https://github.com/o"), (F.col("doc_id") % 9).cast("string"), F.lit("/r/blob/v"), (F.col("doc_id") % 3).cast("string"), F.lit("/src/"), F.coalesce("source", F.lit("-")), F.lit(".py#L"), a.cast("string"), F.lit("-L"), b.cast("string"))
    rows = d.withColumn("url", url)
    rows = rows.select("doc_id", "text", *(c.alias(n) for n, c in paths.blob_parts(F.col("url")).items()))
    span = paths.line_span(F.coalesce("text", F.lit("")), F.col("first_line").cast("int"), F.col("last_line").cast("int"))
    return rows.select("doc_id", "owner", "repo", "ref", "path", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.md5(span).alias("span_md5"))


_LINE = " OR ".join(f"regexp_matches(x, '(?i){p}')" for _, p in SQL_PATTERNS)


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'benchmark', 'item_id', 10)},
r AS (SELECT query_id AS item_id, id AS doc_id, rank, source || '.ts' || chr(10) || {_injected("coalesce(text, '')", 'doc_id')} AS t, string_split({_injected("coalesce(text, '')", 'doc_id')}, chr(10)) AS l FROM bm25 JOIN documents ON doc_id = id),
h AS (SELECT *, rank <= 8 AND {' + '.join(f"{w} * least(2, len(regexp_extract_all(t, '(?i){p}')))" for w, p in SQL_PATTERNS)} >= 6 AS risky, len(list_filter(l, lambda x: {_LINE})) AS k FROM r)
SELECT item_id, doc_id, NOT risky AS cited, CASE WHEN risky THEN k ELSE 0 END::BIGINT AS redactions FROM h WHERE NOT risky OR k / len(l) < 0.4""")
def safe_context(spark, sf_dir):
    """Results of every benchmark passage without what gives orders."""
    found = _with_orders(_results(spark, sf_dir).withColumn("file", F.concat("file", F.lit(".ts"))), F.col("code"), F.col("id"))
    out = safety.safe_results(found, safety.scan(found))
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "cited", F.col("redactions").cast("long").alias("redactions"))


@query("""
WITH m AS (SELECT event_type AS config, user_id AS query_id, median((event_id % 1000 + 1)::DOUBLE) AS m FROM events GROUP BY ALL)
SELECT config, count(*) AS queries, round(avg(m), 6) AS micros FROM m GROUP BY config""")
def latency_by_configuration(spark, sf_dir):
    """Events as samples of how long the queries of configurations took."""
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), F.col("user_id").alias("query_id"), (F.col("event_id") % 1000 + 1).cast("double").alias("micros"))
    return evaluation.latency_summary(samples).select("config", "queries", F.round("micros", 6).alias("micros"))


_NODES = ("function_declaration", "class_definition", "method_definition", "struct_item", "text_chunk", "interface_declaration", "file_summary")


@query(f"""
WITH c AS (SELECT source AS path, ({list(_NODES)!r})[(doc_id % 7 + 1)::INTEGER] AS node FROM documents WHERE doc_id % 5 <> 0)
SELECT path, CASE node WHEN 'function_declaration' THEN 'function' WHEN 'class_definition' THEN 'class' WHEN 'method_definition' THEN 'method' WHEN 'struct_item' THEN 'struct' WHEN 'interface_declaration' THEN 'interface' END AS kind, count(*) AS n
FROM c WHERE node NOT IN ('text_chunk', 'file_summary') GROUP BY ALL""")
def symbol_kind_counts(spark, sf_dir):
    """Documents as chunks of all kinds of nodes; a fifth of them have the names of text chunks."""
    node = F.element_at(F.array(*map(F.lit, _NODES)), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 5 == 0, F.lit("chunk_0")).otherwise("symbol")
    chunks = documents(spark, sf_dir).select(F.lit("repo").alias("repo"), F.col("source").alias("path"), node.alias("node_type"), name.alias("name"))
    return summaries.symbol_kinds(chunks).select("path", "kind", "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_files(spark, sf_dir):
    """Documents as files of a job that has done the labelled ones."""
    return pending(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH r AS (SELECT source AS path, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE source IS NOT NULL GROUP BY source), n AS (SELECT count(*) // 2 AS n FROM documents)
SELECT path, CASE WHEN last <= n THEN 'done' WHEN first < n THEN 'embedding' ELSE 'parsed' END AS status FROM r, n""")
def embedding_progress(spark, sf_dir):
    """Files whose chunks are embedded by half."""
    docs = documents(spark, sf_dir)
    ranges = docs.where("source is not null").groupBy(F.col("source").alias("path")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return summaries.file_progress(ranges, docs.count() // 2)


def _blended(fused: str, name: str, limit: int, weight: str = "0.7") -> str:
    return f"""
{name}_all AS (SELECT f.query_id, f.id, {weight}::DOUBLE * {COS.format(a='s.v', b='a.v')} + (1::DOUBLE - {weight}::DOUBLE) * (f.score / max(f.score) OVER (PARTITION BY f.query_id)) AS score
  FROM {fused} f JOIN store s ON s.id = f.id JOIN asked a ON a.query_id = f.query_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_all) WHERE rank <= {limit})"""


_CONFIGURATIONS = {"full": "hybrid", "not_quantised": "exact", "vectors_only": "dense", "not_reranked": "plain", "several_paths": "several", "page_index": "pages_run"}


@query(f"""
WITH {HYBRID}, {cos_sql('store', 'asked', 1_000_000_000, 'cosl')}, {fuse_sql('cosl', 'bm25', 50, 'fusedx')}, {_blended('fusedx', 'exact', 10)},
hams AS (SELECT query_id, id, 1::DOUBLE AS score FROM ham), {_blended('hams', 'dense', 10, '1.0')},
plain AS (SELECT query_id, id, score, rank FROM fused WHERE rank <= 10),
lone AS (SELECT query_id, 0 AS variant, text, v, w0, w1 FROM asked),
{several_sql('lone', 10, p='m_')},
{PAGE_SEARCH}, pages_run AS (SELECT pf.item_id AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY pf.item_id ORDER BY hits DESC, pf.path, d.doc_id) AS rank FROM pf JOIN documents d ON d.lang || '/' || d.source = pf.path),
lab AS (SELECT d.doc_id AS id, v.label FROM documents d CROSS JOIN n_vec JOIN vec v ON v.id = d.doc_id % nv),
rel AS (SELECT b.item_id AS query_id, lab.id FROM benchmark b CROSS JOIN n_vec JOIN vec v ON v.id = b.item_id % nv JOIN lab ON lab.label = v.label),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
each_ AS ({' UNION ALL '.join(f"({_metrics_sql(run, config)})" for config, run in _CONFIGURATIONS.items())})
SELECT config, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM each_ GROUP BY config""")
def ablation_configurations(spark, sf_dir):
    """All configurations of the search over all documents, asked by the benchmark passages; documents with a vector of the passage's label are relevant."""
    # vectors alone: texts are read by the index, and then only of what was found
    store, asked = stored(chunks(spark, sf_dir).select("id", "v"), "chunks"), stored(text_queries(spark, sf_dir), "asked")
    index, shown = text_index(spark, sf_dir), defined(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source"))
    search = lambda **options: retrieval.hybrid_search(store, asked, limit=10, index=index, **options)
    picked = page_index_search(spark, sf_dir).join(documents(spark, sf_dir).select(F.concat("lang", F.lit("/"), "source").alias("path"), F.col("doc_id").alias("id")), "path").withColumnRenamed("item_id", "query_id")
    by_path = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "path", "id"))
    runs = {
        "full": search(), "not_quantised": search(quantised=False), "vectors_only": search(keywords=False), "not_reranked": search(rerank=False),
        "several_paths": retrieval.multipath_search(store, asked.withColumn("variant", F.lit(0)), limit=10, index=index, shown=shown), "page_index": picked.withColumn("rank", by_path),
    }
    every = stored(reduce(DataFrame.unionByName, (r.select(F.lit(c).alias("config"), "query_id", "id", "rank") for c, r in runs.items())), "runs")
    label = lambda rows, name: numbered(spark, sf_dir, rows, name, "label").select(name, "label")
    qrels = label(asked.select("query_id"), "query_id").join(label(store.select("id"), "id"), "label").select("query_id", "id", F.lit(1).alias("relevance"))
    each = evaluation.metrics(every, qrels, asked.select("query_id"), ("config",))
    each = each.select("config", "query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))
    return each.groupBy("config").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 5).alias(c) for c in ("recall", "mrr", "ndcg")))
