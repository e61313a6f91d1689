from pyspark.sql import functions as F

from quillmesh.functions.vectors import hash_embedding
from quillmesh.operators import chat, extract, retrieval


def test_symbol_chunks(spark):
    py = "import os\n\ndef foo():\n    def inner():\n        pass\n    return inner\n\nclass Bar:\n    def baz(self):\n        pass\n"
    rows = extract.symbol_chunks(extract.python_graph(spark.createDataFrame([("r", "a.py", py), ("r", "b.py", "x = 1")], "repo string, path string, content string"))).orderBy("start_line").collect()
    assert [(r.id, r.node_type, r.start_line, r.end_line) for r in rows] == [("a.py::foo", "function_definition", 3, 6), ("a.py::Bar", "class_definition", 8, 10)]
    assert rows[0].code == "def foo():\n    def inner():\n        pass\n    return inner"


def test_refined_query(spark):
    rows = spark.createDataFrame([("SUFFICIENT",), (" search for parser ",), ("",), (None,), ("x" * 300,)], "r string").select(chat.refined_query(F.col("r")).alias("q")).collect()
    assert [r.q for r in rows] == [None, "search for parser", None, None, "x" * 200]


def test_claim_evidence(spark):
    embed = hash_embedding(64)
    chunks = spark.createDataFrame([(1, "a.ts", "parser reads tokens"), (2, "b.ts", "database pool")], "id long, file string, text string").withColumn("v", embed("text"))
    answers = spark.createDataFrame([("x", ["parser reads tokens", "database pool", "parser", "fourth claim"])], "answer_id string, claims array<string>")
    got = {r.claim: r.evidence for r in retrieval.claim_evidence(answers, chunks, embed).collect()}
    assert set(got) == {"parser reads tokens", "database pool", "parser"} and got["database pool"].startswith("File: b.ts")


def test_multipath_drops_repeated_variants_and_keeps_the_scores_of_an_only_one(spark):
    embed = hash_embedding(64)
    rows = [("a", "alpha parser reads tokens", "parse", ["parse"]), ("b", "database pool alpha", "pool", ["pool"]), ("c", "unrelated words", None, None)]
    chunks = spark.createDataFrame(rows, "id string, text string, name string, definitions array<string>").withColumn("v", embed("text"))
    asked = [(1, 0, "alpha parser"), (1, 1, " alpha parser "), (1, 2, "  "), (2, 0, ""), (2, 1, " \n"), (3, 0, "alpha"), (3, 1, "pool")]
    variants = spark.createDataFrame(asked, "query_id long, variant int, text string").withColumn("q", embed("text"))
    assert [(r.query_id, r.variant, r.text) for r in retrieval.distinct_variants(variants).orderBy("query_id", "variant").collect()] == [(1, 0, "alpha parser"), (3, 0, "alpha"), (3, 1, "pool")]
    got = retrieval.multipath_search(chunks, variants, 3).collect()
    assert {r.query_id for r in got} == {1, 3}
    single = retrieval.hybrid_search(chunks, variants.where("query_id = 1 and variant = 0"), limit=3)
    plain = {r.id: r.score for r in single.collect()}
    pref = {"a": 0.5, "b": 0.25, "c": 0.0}
    assert all(abs(r.score - (0.7 * plain[r.id] + 0.3 * pref[r.id])) < 1e-9 for r in got if r.query_id == 1)
    # "pool" of the second variant is a symbol of the whole query, and a name
    assert [r.id for r in got if r.query_id == 3 and r["rank"] == 1] == ["b"]


def test_a_definition_that_a_chunk_does_not_mention_is_no_bonus(spark):
    rows = [(1, "x", 0.9, 1, ["foo"], "other", ["foo"], "bar only"), (1, "y", 0.9, 2, ["foo"], None, ["foo"], "calls foo")]
    df = spark.createDataFrame(rows, "query_id long, id string, score double, rank int, symbols array<string>, name string, definitions array<string>, code string")
    assert [r.id for r in retrieval.preference_rerank(df, 2, 0.0).orderBy("rank").collect()] == ["y", "x"]


def test_order_without_rerank_is_that_of_the_fused_list(spark):
    vec = lambda *x: [float(v) for v in x]
    chunks = spark.createDataFrame([("z", "word one", vec(1, 1)), ("a", "nothing", vec(-1, 1)), ("m", "word", vec(1, -1)), ("n", "far", vec(-1, -1))], "id string, text string, v array<double>")
    asked = spark.createDataFrame([(1, "word", vec(1, 1))], "query_id long, text string, q array<double>")
    edges = spark.createDataFrame([("z", "n")], "id string, neighbour string")
    got = retrieval.hybrid_search(chunks, asked, edges, 4, coarse=2, dims=2, rerank=False).orderBy("rank").collect()
    fused = retrieval.top(retrieval.fuse(retrieval.hamming_search(chunks.select("id", retrieval.binarized(F.col("v")).alias("bits")), asked.select("query_id", retrieval.binarized(F.col("q")).alias("qbits")), 2, 2), retrieval.bm25.bm25_search(chunks, asked, "id", "text", "query_id", "text", 2)), 2, by=retrieval.fused_order(2))
    assert [r.id for r in got][:2] == [r.id for r in fused.orderBy("rank").collect()] and got[-1].id == "n"


def test_latencies_are_measured_after_warm_ups(spark):
    from quillmesh.operators import evaluation

    queries, seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, text string"), []

    def run(name):
        return lambda batch: seen.append((name, batch.count())) or batch.withColumn("n", F.length("text"))

    got = evaluation.measured({"x": run("x"), "y": run("y")}, queries, warmups=1, samples=2)
    rows = got.collect()
    assert len(rows) == 2 * 3 * 2 and all(r.micros > 0 for r in rows) and seen == [("x", 3)] * 3 + [("y", 3)] * 3
    assert {(r.config, r.queries) for r in evaluation.latency_summary(got).collect()} == {("x", 3), ("y", 3)}
    one = evaluation.measured({"x": run("x")}, queries, warmups=0, samples=3, each=2).collect()
    assert sorted((r.query_id, r["sample"]) for r in one) == [(i, n) for i in (1, 2) for n in range(3)]
