"""The index for given queries: the same scores as the whole index, without the postings of other terms."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import bm25

TEXTS = ["getUserName user_name HTTPServer2x a_b__c", None, "", "the A", "Éa1 b2B x", "aBcD aBcD ABC abC_d 12ab ab12 __x", "user\x00name naïve ÀB user"]


@pytest.fixture
def built(monkeypatch):
    """The indexes that searches have built."""
    found, search = [], bm25.best
    monkeypatch.setattr(bm25, "best", lambda index, *a, **k: (found.append(index), search(index, *a, **k))[1])
    return found


def _rows(df):
    return sorted((r.query_id, r["rank"], repr(r.id), round(r.score, 9)) for r in df.collect())


def test_an_index_for_queries_holds_their_terms_alone_and_gives_the_same_rows(spark, monkeypatch, built):
    monkeypatch.setattr(bm25, "RANGE", 8)
    monkeypatch.setattr(bm25, "KNOWN", 5)
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(3, "again userName"), (None, "no id"), (None, "no name"), (1, None)]
    rows += [(100 + i, " ".join(r.choices([f"w{k}" for k in range(40)], k=r.randrange(1, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "userName naïve w1 w2"), (2, "abc ab12 w1 w1"), (3, "nowhere the"), (4, None), (5, "name 12")], "q long, text string")
    whole = bm25.build_index(docs, "id", "text")
    got = bm25.bm25_search(docs, asked, "id", "text", "q", "text", 9)
    own = built[-1]
    terms = bm25.query_terms(asked, "q", "text")
    assert _rows(got) == _rows(bm25.best(whole, terms, 9)) == _rows(bm25.top(bm25.scores(whole, terms), 9)) and got.count() > 20
    assert (own.documents, own.avgdl, own.ranges) == (whole.documents, whole.avgdl, whole.ranges)
    names = {x.term for x in terms.select("term").collect()}
    held = lambda index: {x.term for x in index.lists.select("term").collect()}
    assert held(own) <= names and held(own) == names & held(whole) and len(held(own)) < len(held(whole)) / 2
    key = lambda index: sorted(map(repr, index.postings.where(F.col("term").isin(*names)).collect()))
    assert key(own) == key(whole)
    assert sorted(map(tuple, own.terms.collect())) == sorted(map(tuple, whole.terms.where(F.col("term").isin(*names)).collect()))


def test_terms_of_one_slot_do_no_harm_and_nothing_asked_or_read_is_no_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i} u{i % 5} v") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "u1 t3 v"), (2, "t7 zz")], "q long, text string")
    want = _rows(bm25.bm25_search(docs, asked, "id", "text", "q", "text", 60))
    for bits in (bytes(bm25.SLOTS // 8), b"\xff" * (bm25.SLOTS // 8)):
        monkeypatch.setattr(bm25, "asked_slots", lambda terms, bits=bits, real=bm25.asked_slots: bytes(a | b for a, b in zip(real(terms), bits)))
        assert _rows(bm25.bm25_search(docs, asked, "id", "text", "q", "text", 60)) == want
    assert bm25.bm25_search(docs, asked.limit(0), "id", "text", "q", "text").count() == 0
    assert bm25.bm25_search(docs.limit(0), asked, "id", "text", "q", "text").count() == 0
    assert bm25.bm25_search(docs.withColumn("text", F.lit(" é ")), asked, "id", "text", "q", "text").count() == 0


def test_slots_are_those_of_the_workers_hash(spark):
    names = [f"term{i}" for i in range(500)] + ["élan", "a_b"]
    bits = bm25.asked_slots(spark.createDataFrame([(n,) for n in names], "term string"))
    assert len(bits) == bm25.SLOTS // 8 and all(bm25._in_slots(n, bits) for n in names)
    assert sum(bm25._in_slots(f"other{i}", bits) for i in range(500)) < 10
