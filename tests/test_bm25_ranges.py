"""The build by ranges and the search that scores a range as a matrix."""

import random

from pyspark.sql import functions as F

from quillmesh.functions.text import token_rows
from quillmesh.operators import bm25
from quillmesh.operators.bm25 import top

TEXTS = ["getUserName user_name HTTPServer2x a_b__c", None, "", "the A", "Éa1 b2B x", "aBcD aBcD ABC abC_d 12ab ab12 __x"]


def test_blocks_hold_what_the_tokens_of_sql_count(spark, monkeypatch):
    monkeypatch.setattr(bm25, "RANGE", 4)
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(3, "again userName"), (None, "no id"), (None, "no id again")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = bm25.build_index(docs, "id", "text")
    want = token_rows(docs, "text").groupBy("id", "term").agg(F.count("*").alias("tf"))
    key = lambda rows: sorted(map(repr, ((r.id, r.term, r.tf) for r in rows.collect())))
    assert key(index.postings) == key(want)
    lengths = {(r.id, r.dl) for r in index.postings.select("id", "dl").distinct().collect()}
    assert lengths == {(r.id, r.dl) for r in want.groupBy("id").agg(F.sum("tf").alias("dl")).collect()}
    by_range = index.blocks.select("term", "range", "n", "max_tf", "min_dl", "tfs", F.inline("docs"))
    assert all(r.own == 0 for r in by_range.select((F.pmod(F.xxhash64("id"), F.lit(index.ranges)) - F.col("range")).alias("own")).collect())
    sums = by_range.groupBy("term", "range", "n", "max_tf", "min_dl", "tfs").agg(F.count("*").alias("a"), F.max("tf").alias("b"), F.min("dl").alias("c"), F.sum("tf").alias("d"))
    assert sums.where("n <> a or max_tf <> b or min_dl <> c or tfs <> d").count() == 0


def test_ranges_give_the_best_of_all_scores_and_no_pair_of_query_and_document_is_a_row(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(bm25, "RANGE", 16)
    monkeypatch.setattr(bm25, "QUERIES", 3)
    monkeypatch.setattr(bm25, "TASK_RANGES", 4)
    rows = [(f"d{i}", " ".join(r.choices([f"c{k}" for k in range(8)], k=r.randrange(1, 20)))) for i in range(300)] + [(f"e{i}", "c0 c1 c1") for i in range(120)]
    index = bm25.build_index(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    asked = spark.createDataFrame([(i, " ".join(r.choices([f"c{k}" for k in range(8)], k=3))) for i in range(9)] + [(9, "nowhere")], "query_id long, text string")
    terms = bm25.query_terms(asked.select(F.struct("query_id", F.lit("x").alias("variant")).alias("query_id"), "text"), "query_id", "text")
    key = lambda rows: sorted((x.query_id.query_id, x["rank"], x.id, round(x.score, 9)) for x in rows.collect())
    for limit in (1, 7, 200):
        assert key(bm25.best(index, terms, limit)) == key(top(bm25.scores(index, terms), limit))
    plan = bm25._best_of_ranges(index, bm25.weighted_terms(index, terms), 7, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[query_id" not in plan
