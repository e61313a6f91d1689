"""Exact Hamming search by blocks: no pair of a code and a query is a row."""

import random

from pyspark.sql import functions as F

from quillmesh.functions.vectors import hamming_words
from quillmesh.operators import dense, retrieval
from quillmesh.operators.bm25 import top


def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(dense, "CODES", 50)
    monkeypatch.setattr(dense, "CODE_QUERIES", 4)
    bits = lambda: [r.choice([0, 1, 3, 2**32 - 1, r.getrandbits(32)]), r.choice([0, 5, r.getrandbits(32)])]
    codes = spark.createDataFrame([(f"v{i}", bits()) for i in range(230)] + [("w0", [7]), ("w1", [7]), ("w2", [])], "id string, bits array<bigint>")
    asked = spark.createDataFrame([(i, bits()) for i in range(11)], "n long, qbits array<bigint>").select(F.struct("n").alias("query_id"), "qbits")
    key = lambda rows: sorted((x.query_id.n, x["rank"], x.id, -1 if x.dist is None else x.dist) for x in rows.collect())
    for dims in (32, 64):
        pairs = codes.crossJoin(asked).withColumn("dist", hamming_words(F.col("bits"), F.col("qbits"), dims // 32))
        for limit in (1, 20):
            got = retrieval.hamming_search(codes, asked, limit, dims)
            assert key(got) == key(top(pairs, limit, by=[F.col("dist"), F.col("id")]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "bit_count" not in plan
