import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions import words as W
from quillmesh.operators import bm25, chat, retrieval


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_word_lists():
    assert len(set(W.SEARCH_STOP)) == 143 and len(set(W.EXPANSION_STOP)) == 108 and len(set(W.SUMMARY_STOP)) == 45 and len(set(W.EVIDENCE_STOP)) == 57


def test_tokens(spark):
    assert col(spark, "getUserName", T.code_tokens) == ["getusername", "user", "name"]
    assert col(spark, "snake_part the a", T.code_tokens) == ["snake_part", "snake", "part"]
    assert col(spark, None, T.code_tokens) == []


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "authenticate(user)"), (2, "connectDatabase()"), (3, "helper authenticated éauthenticate")], "id long, text string")
    ask = lambda q: [r.id for r in retrieval.keyword_search(docs, spark.createDataFrame([(1, q)], "query_id long, text string")).orderBy("rank").collect()]
    assert ask("authenticate") == [1, 3] and ask("connectDatabase") == [2] and ask("nonsense") == []


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "alpha gamma"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "zzz")], "qid long, q string")
    got = bm25.bm25_search(docs, asked, "id", "text", "qid", "q").orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == [1, 2, 3]


def test_a_stored_index_answers_for_its_snapshot_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3}" + " beta" * (i % 2)) for i in range(60)] + [(99, None)], "id long, text string")
    index, path = bm25.build_index(docs, "id", "text"), str(tmp_path / "bm25")
    asked = spark.createDataFrame([(1, "beta w3"), (2, "nothing"), (3, "w5 w5 w1")], "query_id long, text string")
    terms = bm25.query_terms(asked, "query_id", "text")
    rows = lambda i: sorted((r.query_id, r.id, r["rank"], round(r.score, 9)) for r in bm25.best(i, terms, 5).collect())
    bm25.save_index(index, path, "r", "s1")
    assert rows(bm25.load_index(spark, path, "r", "s1")) == rows(index) and bm25.load_index(spark, path, "r", "s2") is None
    (tmp_path / "bm25/repo=r/sha=s3/blocks").mkdir(parents=True)
    assert bm25.load_index(spark, path, "r", "s3") is None  # a build that died
    lengths = {r.id: r.dl for r in index.postings.select("id", "dl").distinct().collect()}
    assert len(lengths) == 60 and index.documents == 61 and abs(index.avgdl - sum(lengths.values()) / 61) < 1e-12
    empty = bm25.build_index(docs.limit(0), "id", "text")
    assert bm25.best(empty, terms).count() == 0 and empty.avgdl == 1.0


def test_a_pruned_search_gives_the_same_rows(spark, monkeypatch):
    import random

    r = random.Random(3)
    monkeypatch.setattr(bm25, "RANGE", 8)
    monkeypatch.setattr(bm25, "BUCKET", 200)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(150)]
    rows = [(i, " ".join(r.choices(common, k=r.randrange(1, 30)) + r.choices(rare, k=r.randrange(3)))) for i in range(400)] + [(i, "c0 c1 r7") for i in range(400, 430)]
    index = bm25.build_index(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert index.ranges > 40 and index.buckets > 3
    asked = spark.createDataFrame([(i, " ".join(r.sample(common, 2) + r.sample(rare, 3))) for i in range(8)] + [(8, "c0 c1 r7"), (9, "nowhere")], "query_id long, text string")
    terms = bm25.query_terms(asked, "query_id", "text")
    for limit in (3, 25, 1000):
        got = [sorted((x.query_id, x.id, x["rank"], round(x.score, 9)) for x in bm25.best(index, terms, limit, pruned=p, first=2).collect()) for p in (False, True)]
        assert got[0] == got[1] and got[0]
    weights = bm25.weighted_terms(index, terms)
    best = {(x.query_id, x.range): x.m for x in bm25.scores(index, terms).withColumn("range", F.pmod(F.xxhash64("id"), F.lit(index.ranges)).cast("int")).groupBy("query_id", "range").agg(F.max("score").alias("m")).collect()}
    bound = {(x.query_id, x.range): x.bound for x in bm25.bounds(index, weights).collect()}
    assert set(best) == set(bound) and all(bound[k] >= best[k] - 1e-9 for k in best)


def test_a_search_reads_the_buckets_of_its_terms_before_anything_is_grouped(spark, monkeypatch):
    import re

    monkeypatch.setattr(bm25, "BUCKET", 50)
    index = bm25.build_index(spark.createDataFrame([(i, f"t{i} u{i % 5}") for i in range(300)], "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "t17")], "query_id long, text string")
    plan = bm25.scores(index, bm25.query_terms(asked, "query_id", "text"))._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[[^\]]*docs[^\n]*", plan)
    assert index.buckets > 5 and len(scans) == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", scans[0])
    # one aggregation, of what the join with the asked terms has left; no statistic is counted again
    assert plan.count("HashAggregate(keys=[query_id") == 2 and "keys=[term" not in plan and "keys=[id#" not in plan


@pytest.mark.parametrize("q, follow", [("is it the same?", True), ("explain database connection pooling", False)])
def test_follow_up(spark, q, follow):
    assert col(spark, q, chat.is_follow_up) == follow


def test_expansion(spark):
    assert col(spark, "how does handleError work", chat.expanded) == ["how does handleError work", "handleError implementation definition"]
    assert col(spark, "", chat.expanded) == [""] and col(spark, None, chat.expanded) == [""]
    assert col(spark, "why", chat.expanded) == ["why"]


def test_contextual_query(spark):
    turns = [(1, 0, "user", "how does fetchUser work"), (1, 1, "assistant", "fetchUser calls tryCatch"), (1, 2, "user", " is it the same? "), (2, 0, "user", "explain database pooling strategy")]
    got = {r.conv_id: r.query for r in chat.contextual_queries(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: "is it the same? fetchUser calls tryCatch", 2: "explain database pooling strategy"}


def test_islands_and_prompt(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", " "), (1, 4, "assistant", "c"), (1, 5, "user", "d"), (1, 6, "assistant", "e"), (1, 7, "system", "sys"), (2, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.role, r.text) for r in chat.islands(df).orderBy("island").collect()] == [("user", "a\n\nb"), ("model", "c"), ("user", "d")]
    got = chat.prompts(df).collect()
    assert len(got) == 1 and got[0].history == ["sys\n\n---\n\na\n\nb", "c"] and got[0].prompt == "d"


def test_window(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.history_window(df, chat.HISTORY["mlc"]).count() == 6 and chat.history_window(df, chat.HISTORY["groq"]).count() == 10
    assert {r.turn for r in chat.history_window(df, 6).collect()} == set(range(14, 20))


def test_flags(spark):
    assert col(spark, "Where is the default batch size?", lambda c: chat.matches_any(c, chat.FACT))
    assert not col(spark, "valuesé", lambda c: chat.matches_any(c, ("zzz",)))
    assert col(spark, "What is this project", lambda c: chat.matches_any(c, chat.OVERVIEW))
    assert col(spark, "draw /viz of it", chat.without_flags) == "draw  of it"


def test_small_parts(spark):
    assert col(spark, "1. first claim\nno\n2) second", chat.claims) == ["first claim", "second"]
    hidden = col(spark, "<think>why</think> so", lambda c: F.concat_ws("|", *chat.think_split(c)))
    assert hidden == "why|so"
    assert col(spark, "1. alpha beta\n- Alpha Beta\nq\n2) gamma", lambda c: chat.variant_lines(c, F.lit("query"))) == ["query", "alpha beta", "gamma"]
    rows = spark.createDataFrame([(1, 0, "user", "  "), (1, 1, "user", "a  b\n" + "x" * 60), (2, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.title for r in chat.titles(rows).collect()}
    assert got[1] == ("a b " + "x" * 60)[:40] + "..." and got[2] == "New chat"
