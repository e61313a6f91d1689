"""Each stage of the pipeline on its own input, against plain versions."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import brute  # noqa: E402
from oracle import SF  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillmesh.llm import toxicity  # noqa: E402
from quillmesh.workspace import stored  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, seen[-1], SF), f"test-{name}")
        assert out.columns == columns and out.dtypes == docs.dtypes
        seen.append(out)
    texts = [[(r.doc_id, r.text) for r in d.collect()] for d in seen]
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {i for i, _ in texts[1]} == {i for i, p in verdict.items() if not p}
    assert {i: brute.sha(t or "") for i, t in texts[2]} == {i: x[2] for i, x in brute.lines(texts[1]).items()}
    assert all(r.n_chars == len(r.text or "") for r in seen[2].collect())
    assert {i for i, _ in texts[3]} == brute.survivors(texts[2])
    sources = {r.doc_id: r.source for r in seen[3].collect()}
    size, total, target = brute.mixture(texts[3], sources)
    taken, times = Counter(), Counter(i for i, _ in texts[4])
    for i, n in times.items():
        assert n <= 2
        taken[sources[i]] += n * size[i]
    assert all(target[s] - 1 <= taken[s] <= target[s] + max(size[i] for i in size if sources[i] == s) for s in total)
    ids = brute.tokens(texts[3], public_tokenizers.path("byte_bpe_50k.json"), 0)
    out = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF)
    words, sequences = Counter(), defaultdict(int)
    for r in out.collect():
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
        words[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert words == Counter({i: n * len(ids[i]) for i, n in times.items()})
    assert sum(n != 1024 for n in sequences.values()) <= 1
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == sum(words.values())


def odd_table(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    line = "a line that many of the documents here hold"
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, None, "en", "s", None), (2, "", None, "s", 0), (None, f"{line}\nno id", "en", None, 50), (None, f"{line}\nnone either", "en", None, 50), (3, f"{line}\nthree", "en", "s", 1), (4, f"{line}\nfour", "en", "t", 1),
        (5, words, "en", "t", 1), (5, words, "en", "t", 1), (5, f"{words} and more", "en", "t", 1), (6, words + " ", "en", "t", 1), (7, "x" * 300_000, "en", "s", 1), (8, "long " * 60_000, None, None, 1), (9, "é ñ Σας\x00 　", "en", "s", 1),
    ]
    names = ("score", "id", "kept", "docs", "taken", "doc", "epoch", "spread", "n_lines", "n_dropped", "h", "k", "node", "key", "c0", "text_", "times")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({n: F.lit("clash") for n in names})


def test_stages_on_odd_rows(spark):
    docs = odd_table(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), f"odd-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert all(r.score == r.n_lines == r.epoch == "clash" for r in got)
        by = Counter(r.doc_id for r in got)
        if name in ("toxicity", "line_dedup"):
            assert len(got) == n
        if name == "near_dedup":
            assert by[None] == 2 and by[1] == 1 and not by[2] and not by[6] and by[5] == 3
        if name == "mixing":
            assert not by[1] and max(by.values()) <= 6 and by[5]
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("start = 0").collect()) == Counter(r.doc_id for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_epochs_of_a_document_lie_apart(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "s") for i in range(300)], "doc_id long, text string, source string")
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert max(Counter(got).values()) == 2 and sum(a == b for a, b in zip(got, got[1:])) < 10
