"""Quality rules, spelling variants and ranked search against plain versions."""

import random
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import brute  # noqa: E402
from oracle import SF, connection  # noqa: E402

from quillmesh.llm import quality, search, spelling  # noqa: E402

LONG = " ".join(f"wörd{i * 7919 % 1000}x Label" for i in range(4000))
ODD = [
    (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "spelling spelling speling spelling spelling spelling"), (5, "Spelling-spelling;speling speling speling speling spelling spelling"), (6, LONG), (7, LONG + " tail"), (7, LONG + " tail"),
    (8, "x" * 70000), (9, "É́ ñ Σας zßẞ 日本語 ÿÿÿÿÿÿ"), (10, "the same line\nthe same line\n\n \nother"), (None, "spelling spelling none"), (None, "none of these"), (-5, "# a * b $ % & | < > \n# a * b $"),
]
CLASHES = ("id", "word", "n", "term", "shard", "item", "df", "score", "rank", "stratum", "bins", "kept", "bound")


@pytest.fixture(scope="module")
def small():
    return connection().sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, None if i is None or i % 3 == 0 else f"l{i % 2}") for i, t in ODD], "doc_id long, text string, lang string")
    return df.withColumns({n: F.lit("clash") for n in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(-5, 11)], "doc_id long, quality int")


# quality


def test_counts_of_quality(spark, small, odd, labels):
    own = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs, df in ((small, spark.read.parquet(f"{SF}/documents.parquet")), (ODD, odd)):
        assert Counter(tuple(r[c] for c in own) for r in quality.quality(df, labels).collect()) == Counter(brute.quality_counts(docs))
    assert quality.quality(odd.limit(0), labels).count() == 0 and quality.quality(odd, labels.limit(0)).count() == len(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(2, 9))
def test_repeated_words(words, window):
    at = [tuple(words[j : j + window]) for j in range(len(words) - window + 1)]
    twice = Counter(at)
    assert quality.repeated_words([w.encode() for w in words], window) == len({k for j, a in enumerate(at) if twice[a] > 1 for k in range(j, j + window)})


def test_upper_bounds_are_exact():
    from fractions import Fraction
    from math import comb

    def tail(k, n, p):
        p = Fraction(p)
        return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))

    for n in (1, 7, 40, 250):
        for k in {0, 1, n // 3, n - 1}:
            for p in (0.01, 0.2, 0.5, 0.93):
                assert quality.binomial_tail(k, n, p) == pytest.approx(tail(k, n, p), abs=1e-11)
            u = quality.upper_bound(k, n, 0.01)
            assert k == n or tail(k, n, u) == pytest.approx(0.01, abs=1e-6)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100)) and quality.upper_bound(5, 5, 0.1) == 1.0
    assert 0.0100 < quality.upper_bound(100_000, 10_000_000, 0.01) < 0.0102


def made_texts(seed, n, junk):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(40)]
        bad = r.random() < junk
        rows.append((i, " ".join(w + "***" for w in words) if bad else " ".join(words), "de" if i % 3 else "en", 0 if bad else 1))
    return rows


def test_rules_reject_junk_and_keep_their_limit(spark):
    rows = made_texts(3, 1500, 0.2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: r for r in quality.quality(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    assert all(got[i].kept == bool(q) for i, _, _, q in rows) and all(0 < r.bound <= 0.05 for r in got.values())


def test_too_few_labels_certify_nothing(spark):
    rows = made_texts(4, 90, 0.3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    assert all(r.kept and r.bound is None for r in quality.quality(df, df.select("doc_id", "quality")).collect())


def test_a_useless_rule_is_not_used_and_levels_stop_at_the_first_that_fails(spark):
    # capitals tell nothing: as many good as bad rows have them
    rows = [("s", [0, 30 if i % 5 == 0 else 0, 0, 0, 0, 0, 5, 5], i % 2 == 0, i % 4 < 2) for i in range(2000)]
    labelled = spark.createDataFrame(rows, "stratum string, bins array<int>, good boolean, tuning boolean")
    (row,) = quality.proposals(labelled).collect()
    assert all(c == quality.GRID + 1 for at in row.cuts for c in at)
    # a rule that pays in the tuning part and fails in the holdout
    rows = [("s", [40 if (not good and i % 2) or (good and not tuning and i % 9 == 0) else 0, *[0] * 7], good, tuning) for i in range(600) for good in (True, False) for tuning in (True, False)]
    labelled = spark.createDataFrame(rows, "stratum string, bins array<int>, good boolean, tuning boolean")
    (row,) = quality.certified(labelled, quality.proposals(labelled), 0.05, 0.05).collect()
    assert row.cuts[0][0] == 40 and row.level == -1 and row.bound is None


def test_quality_against_a_plain_version_of_its_verdict(spark):
    """Proposals and certificates once more, by loops over the rows."""
    r = random.Random(8)
    rows = [(f"s{i % 2}", [min(60, int(abs(r.gauss(0, 4 if good else 25)))) for _ in quality.RULES], good, bool(r.randrange(2))) for i, good in ((i, r.random() < 0.8) for i in range(3000))]
    labelled = spark.createDataFrame(rows, "stratum string, bins array<int>, good boolean, tuning boolean")
    got = {x.stratum: x for x in quality.certified(labelled, quality.proposals(labelled), 0.05, 0.05).collect()}
    for s in ("s0", "s1"):
        mine = [x for x in rows if x[0] == s]
        cuts = []
        for k in range(len(quality.RULES)):
            at = []
            for share in quality.LEVELS:
                best = (0, quality.GRID + 1)
                for c in sorted({b[k] for _, b, _, t in mine if t}, reverse=True):
                    good, bad = (sum(b[k] >= c for _, b, g, t in mine if t and g == want) for want in (True, False))
                    total = sum(g and t for _, _, g, t in mine)
                    if good <= share * total and bad - quality.PRICE * good > best[0]:
                        best = (bad - quality.PRICE * good, c)
                at.append(best[1])
            cuts.append(at)
        hold = [b for _, b, g, t in mine if g and not t]
        level, bound = -1, None
        for i in range(len(quality.LEVELS)):
            u = quality.upper_bound(sum(any(x >= at[i] for x, at in zip(b, cuts)) for b in hold), len(hold), 0.05 / 2)
            if u > 0.05:
                break
            level, bound = i, u
        assert [list(c) for c in got[s].cuts] == cuts and got[s].level == level and got[s].bound == (bound if bound is None else pytest.approx(bound))


# spelling


def spelled(df, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect()}


@pytest.mark.parametrize("block", [3, 4096])
def test_spelling(spark, small, odd, block):
    for docs, df in ((small, spark.read.parquet(f"{SF}/documents.parquet")), (ODD, odd)):
        assert spelled(df, block=block) == brute.spelling(docs)
    assert spelled(odd)["speling"][:2] == (None, "speling")
    assert spelled(odd.limit(0)) == {}


def test_roots_follow_chains(spark):
    text = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaabb"] * 125 + ["aaabbb"] * 700)
    got = spelled(spark.createDataFrame([(3, text)], "doc_id long, text string"))
    assert got == brute.spelling([(3, text)]) and got["aaaaaa"][1] == "aaabbb"


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_complete_and_found_once(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(700)}
    got = Counter((x.a, x.b) for x in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 16).collect())

    def near(a, b):
        return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    want = {(a, b) for a, b in combinations(sorted(words, key=lambda w: (len(w), w)), 2) if near(a, b)}
    assert set(got) == want and max(got.values()) == 1


# search


def test_search(spark, small, odd):
    items = connection().sql("SELECT item_id, text FROM benchmark").fetchall()
    for docs, df, asked in ((small, spark.read.parquet(f"{SF}/documents.parquet"), items), (ODD, odd, [(1, "spelling label"), (2, ""), (3, None), (None, "wörd0x ÿÿÿÿÿÿ"), (4, "TAIL 日本語"), (1, "none"), (5, "nowhere")])):
        given_ = spark.createDataFrame(asked, "item_id long, text string").withColumn("term", F.lit(1))
        for shard_bytes, block in ((1 << 24, 1024), (3000, 2)):
            path = search.new_path(spark, "index")
            search.build_index(df, path, shard_bytes=shard_bytes)
            for most in (50, 3):
                got = sorted((tuple(r) for r in search.search(search.read_index(spark, path), given_, most, block=block).collect()), key=repr)
                assert got == sorted(brute.search(docs, asked, most), key=repr)
    for docs, asked in ((odd.limit(0), [(1, "one")]), (odd, [])):
        assert search.ranked_search(docs, spark.createDataFrame(asked, "item_id long, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 62), max_size=30), max_size=6))
def test_packed_lists(lists):
    flat = np.array([x for v in lists for x in v], np.uint64)
    got = search.packed(flat, np.cumsum([len(v) for v in lists], dtype=np.int64))
    assert [search.unpacked(b.as_py()).tolist() for b in got] == lists


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 6), min_size=1), max_size=6), st.integers(1, 8))
def test_best_skips_nothing(lists, most):
    total = Counter()
    for x in lists:
        total.update(x)
    want = sorted((-s, d) for d, s in total.items() if s)[:most]
    given_ = [(sorted(x), [x[d] for d in sorted(x)], max(x.values()), sorted(x.values())[-most] if len(x) >= most else 0) for x in lists]
    assert sorted((-s, d) for s, d in search.best(given_, most)) == want


def test_very_long_texts(spark):
    """One text of some megabytes among short ones, through operators that have no such test elsewhere."""
    from quillmesh.llm import token_files, toxicity

    long_ = " ".join(f"lòng{i % 977}word idiot" for i in range(250_000))
    rows = [(1, "short idiot text", "x"), (2, long_, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    no_labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(df, no_labels).collect()}[2] in (0, 1)
    path = search.new_path(spark, "tokens")
    import public_tokenizers

    token_files.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_tokens(spark, path).collect()}
    assert got[1][0] == 0 and got[2][0] == got[1][1] and got[3] == (got[2][0] + got[2][1], 1) and got[2][1] > 500_000
    q = {r.doc_id: r for r in quality.quality(df, no_labels).collect()}
    assert q[2].n_words == 500_000 and q[2].n_repeat_words == 500_000 and q[2].base_failed
    words = spelled(df)
    assert words == brute.spelling([r[:2] for r in rows])
    item = spark.createDataFrame([(9, "lòng5word short")], "item_id long, text string")
    assert sorted(map(tuple, search.ranked_search(df, item).collect())) == sorted(brute.search([r[:2] for r in rows], [(9, "lòng5word short")]))


def test_tokens_of_rows_that_repeat_an_id(spark):
    import public_tokenizers

    from quillmesh.llm import token_files

    path = search.new_path(spark, "tokens")
    df = spark.createDataFrame([(5, f"text {i}") for i in range(40)] + [(None, f"none {i % 3}") for i in range(20)] + [(1, "first")], "doc_id long, text string")
    token_files.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 20 + [1] + [5] * 40 and [r.start for r in got][1:] == [r.start + r.n_tokens for r in got][:-1]
