"""Queries over the ten best documents of every passage, on tables with odd rows."""

import pytest

from quillmesh import catalog
from quillmesh.operators import bm25
from quillmesh.plans import retrieval


def _tables(spark, folder, source):
    """Documents of which one has no text and the last this source; one passage has no text and one finds nothing."""
    docs = [(i, f"alpha beta{i % 3} gamma{i} unasked{i}", "en", f"s{i % 4}") for i in range(30)] + [(30, None, "en", "s1"), (31, "alpha delta", "en", source)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "alpha gamma7"), (2, "beta2 delta"), (3, None), (4, "nothing here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture
def odd(spark, tmp_path):
    return _tables(spark, str(tmp_path), None)


@pytest.fixture
def held(monkeypatch):
    """The terms of the indexes that are searched."""
    found, search = [], bm25.best
    monkeypatch.setattr(bm25, "best", lambda index, *a, **k: (found.append({r.term for r in index.lists.select("term").distinct().collect()}), search(index, *a, **k))[1])
    return found


def _expected(name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.sql(catalog.ORACLES[name]).fetchall()))


def _checked(spark, name, folder, held):
    rows = catalog.QUERIES[name](spark, folder)
    assert sorted(repr(tuple(r)) for r in rows.collect()) == _expected(name, folder)
    # of the documents' 64 terms
    assert held == [{"alpha", "gamma7", "beta2", "delta"}]


def test_baseline_context_indexes_what_is_asked_and_stores_no_texts(spark, odd, held, monkeypatch):
    names = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name, real=retrieval.stored: (names.append(name), real(df, name))[1])
    _checked(spark, "baseline_context", odd, held)
    assert "results" not in names


def test_correlated_citations_indexes_what_is_asked(spark, odd, held):
    _checked(spark, "correlated_citations", odd, held)


def test_evidence_coverage_indexes_what_is_asked(spark, odd, held):
    _checked(spark, "evidence_coverage", odd, held)


def test_context_raw_indexes_what_is_asked(spark, tmp_path, held):
    _checked(spark, "context_raw", _tables(spark, str(tmp_path), "s9"), held)
