"""Near copies by their five-word Jaccard similarity, planted and against all pairs."""

import random
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from brute import shingles, survivors  # noqa: E402
from oracle import SF  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillmesh.llm import near_copies  # noqa: E402


def planted(seed=7, n=200, words=300):
    """Documents and copies with two to seven words changed; ids of the pairs at 0.8 or more."""
    r, rows, pairs = random.Random(seed), [], []
    for i in range(n):
        text = [f"w{r.randrange(50_000)}" for _ in range(words)]
        copy = list(text)
        for p in r.sample(range(words), 2 + i % 6):
            copy[p] = f"x{r.randrange(50_000)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append(2 * i + 1)
    return rows, pairs


def test_planted_pairs_at_least_08_go(spark):
    rows, pairs = planted()
    assert len(pairs) > 150
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= set(pairs)
    assert len(gone) >= 0.995 * len(pairs)


def test_stage_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == survivors(rows)


def test_odd_rows(spark):
    rows = [(None, "one two three"), (5, "One  two three"), (4, "one two three"), (7, None), (8, " "), (9, "")]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == [(False, 4), (False, 7), (True, None)]


def test_many_copies_of_one_text_join_through_it(spark, monkeypatch):
    """Copies that are alike to their text and less so to each other; the pairs that are looked at don't grow with their square."""
    r = random.Random(3)
    base = [f"w{r.randrange(50_000)}" for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        copy = list(base)
        for p in r.sample(range(0, 300, 7), 6):
            copy[p] = f"x{r.randrange(50_000)}"
        rows.append((i, " ".join(copy)))
    looked = []
    kept = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *a: looked.append(pairs.distinct().count()) or kept(pairs, *a))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {x.doc_id for x in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got == survivors(rows) and len(got) < 5
    assert sum(looked) < 150 * 40
