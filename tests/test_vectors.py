import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.operators import dense as D
from quillmesh.operators import retrieval as R


def one(spark, v, expr):
    return spark.createDataFrame([(v,)], "v array<double>").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "v, bits",
    [([1, -0.5, 0.3, -0.1, 0, 2, -3, 0.01], [165]), ([-1.0, -2.0], [0]), ([1.0 if i in (0, 33) else -1.0 for i in range(64)], [1, 2]), ([1.0 if i == 31 else 0.0 for i in range(32)], [2147483648]), ([], [])],
)
def test_binarized(spark, v, bits):
    assert one(spark, [float(x) for x in v], V.binarized) == bits


def test_hamming_and_cosine(spark):
    df = spark.createDataFrame([([0b1111], [0]), ([1, 1], [0, 0]), ([7], [7, 9])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(V.hamming(F.col("a"), F.col("b"))).collect()] == [4, 2, 0]
    assert [r[0] for r in df.select(V.hamming(F.col("b"), F.col("a"))).collect()] == [4, 2, 0]
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1, -1, 0, 0]
    assert one(spark, [3.0, 4.0], V.l2_normalized) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], V.l2_normalized) == [0, 0]


@pytest.mark.parametrize(
    "device, cores, memory, expected",
    [("webgpu", 16, 16, (16, 1)), ("webgpu", 8, 8, (12, 1)), ("webgpu", 4, 4, (8, 1)), ("wasm", 16, 16, (8, 2)), ("wasm", 8, 8, (6, 1)), ("wasm", 4, 4, (4, 1)), ("wasm", 2, 0, (2, 1))],
)
def test_embed_config(device, cores, memory, expected):
    assert V.embed_config(device, cores, memory) == expected


@given(st.text(max_size=20))
def test_hash_vector_is_a_unit_vector(text):
    assert abs(np.linalg.norm(V.hash_vector(text, 64)) - 1) < 1e-9
    assert (V.hash_vector(text, 64) == V.hash_vector(text, 64)).all()


def test_embedder_and_pooling(spark):
    got = spark.createDataFrame([("a",), (None,)], "t string").select(V.hash_embedding(32)("t").alias("v")).collect()
    assert got[0].v == V.hash_vector("a", 32).tolist() and got[1].v == V.hash_vector("", 32).tolist()
    states = np.array([[[1.0, 0.0], [0.0, 5.0]]])
    assert V.mean_pooled(states, np.array([[1, 0]])).tolist() == [[1.0, 0.0]]


def test_fusion(spark):
    rows = [("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 0, "c", 3), ("q", 1, "b", 1), ("q", 1, "c", 2), ("q", 1, "d", 3)]
    df = spark.createDataFrame(rows, "query_id string, l int, id string, rank int")
    lists = [df.where(f"l = {i}").drop("l") for i in (0, 1)]
    got = R.top(R.fuse(*lists), 10, by=R.fused_order(2)).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c", "a", "d"]
    assert R.fuse(df.where("l = 7").drop("l")).count() == 0
    flipped = {r.id: r.score for r in R.fuse(*lists[::-1]).collect()}
    assert flipped == pytest.approx({r.id: r.score for r in got})


def test_query_blocks_give_the_same_rows(spark, monkeypatch):
    v = spark.range(30).select("id", F.array(*[F.sin(F.col("id") * k).alias(str(k)) for k in range(1, 5)]).alias("v"))
    q = v.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    first = sorted(R.cosine_search(v, q, 5).collect())
    monkeypatch.setattr(D, "SENT_BYTES", 100)
    assert sorted(R.cosine_search(v, q, 5).collect()) == first


def test_graph_expansion(spark):
    seeds = spark.createDataFrame([("q", "s", 0.8, 1), ("q", "t", 0.4, 2)], "query_id string, id string, score double, rank int")
    edges = spark.createDataFrame([("s", "n"), ("t", "n"), ("t", "s"), ("x", "y")], "id string, neighbour string")
    got = {r.id: (r.score, r.expanded) for r in R.expand_with_graph(seeds, edges).collect()}
    assert got == {"s": (0.8, False), "t": (0.4, False), "n": (0.4, True)}


def test_preference(spark):
    rows = [("q", 1, 0.5, 1, ["foo"], "a", ["foo"], "nothing"), ("q", 2, 0.5, 2, ["foo"], "b", [], "calls foo here")]
    df = spark.createDataFrame(rows, "query_id string, id int, score double, rank int, symbols array<string>, name string, definitions array<string>, code string")
    assert R.preference_rerank(df, alpha=0.0).orderBy("rank").first().id == 2
    empty = df.withColumn("symbols", F.array().cast("array<string>"))
    assert [r.id for r in R.preference_rerank(empty).orderBy("rank").collect()] == [1, 2]


def test_hybrid_without_variants_or_chunks(spark):
    chunks = spark.createDataFrame([(1, "auth user login", [0.5, 0.3, -0.1, 0.8]), (2, "database pool", [-0.5, -0.3, 0.1, -0.8])], "id long, text string, v array<double>")
    asked = spark.createDataFrame([(1, "login", [0.5, 0.3, -0.1, 0.8])], "query_id long, text string, q array<double>")
    assert R.hybrid_search(chunks, asked, dims=4).orderBy("rank").first().id == 1
    assert R.hybrid_search(chunks, asked.limit(0), dims=4).count() == 0
    assert R.hybrid_search(chunks.limit(0), asked, dims=4).count() == 0
    dup = asked.withColumn("variant", F.lit(0)).unionByName(asked.withColumn("variant", F.lit(1)))
    assert R.multipath_search(chunks, dup, dims=4).orderBy("rank").first().id == 1


def test_baseline(spark):
    results = spark.createDataFrame([("q", 5, "src/a.ts", 0.9)], "query_id string, id long, file string, score double")
    chunks = spark.createDataFrame([(1, "README.md", 0), (2, "README.md", 1), (3, "package.json", 2), (5, "src/a.ts", 3)], "id long, file string, ord int")
    got = R.inject_baseline(results, spark.createDataFrame([("q",)], "query_id string"), chunks).collect()
    assert {(r.id, r.score) for r in got} == {(5, 0.9), (1, 0.0), (3, 0.0)}


def test_ranks_among_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(300)] + [(i, [0.0] * 6) for i in range(300, 304)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    monkeypatch.setattr(D, "VECTORS", 64)
    wanted = q.select("query_id").crossJoin(v.where("id % 7 = 1 or id > 298").select("id"))
    every = {(r.query_id, r.id): r.rank for r in D.cosine_search(v, q, 1000).collect()}
    got = {(r.query_id, r.id): r["rank"] for r in D.cosine_ranks(v, q, wanted).collect()}
    assert len(every) == 304 * 7 and len(got) == wanted.count() and all(every[k] == r for k, r in got.items())


def test_bulk_cosine_compares_what_both_have(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 9.0]), (2, [0.0, 1.0]), (3, []), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [])], "query_id long, q array<double>")
    got = {(r.query_id, r.id): r.score for r in D.cosine_search(v, q, 9).collect()}
    assert got == {(7, 1): 1.0, (7, 2): 0.0, (7, 3): 0.0, (7, 5): 0.0, (8, 1): 0.0, (8, 2): 0.0, (8, 3): 0.0, (8, 5): 0.0}
    assert D.cosine_search(v.limit(0), q).count() == 0 and D.cosine_search(v, q.limit(0)).count() == 0


def test_hamming_tables_find_the_rows_of_a_scan(spark):
    import random

    from quillmesh.operators import hamming_tables as T

    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(12)]
    values = [c ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for c in centres for _ in range(20)] + [r.getrandbits(64) for _ in range(160)] + centres[:2] * 3
    words = lambda v: [v & 0xFFFFFFFF, v >> 32]
    codes = spark.createDataFrame([(i, words(v)) for i, v in enumerate(values)], "id long, bits array<long>")
    asked = spark.createDataFrame([(i, words(v)) for i, v in enumerate([*centres[:6], *(r.getrandbits(64) for _ in range(4)), values[-1]])], "query_id long, qbits array<long>")
    own = ["query_id", "id", "dist", "score", "rank"]
    for limit, width, share in ((4, 16, 0.05), (15, 8, 0.5), (500, 16, 0.05), (3, 32, 1e-6)):
        got = T.table_search(codes, asked, limit, 64, width, share)
        assert sorted(got.select(own).collect()) == sorted(R.hamming_search(codes, asked, limit, 64).select(own).collect())
        if limit == 4:
            by = {x.query_id: (x.round, x.candidates) for x in got.collect()}
            assert {q for q, (k, _) in by.items() if k >= 0} >= {0, 1, 2, 3, 4, 5} and all(n < 0.3 * len(values) for q, (k, n) in by.items() if q < 6)
            assert all(by[q] == (-1, len(values)) for q in range(6, 10))
    assert T.table_search(codes.limit(0), asked, 3).count() == 0 and T.table_search(codes, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="segments"):
        T.segment_table(codes, 64, 12)
