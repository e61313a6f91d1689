import pytest

from quillmesh.catalog import ORACLES, QUERIES, flagship

from oracle import SF, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, con, name):
    same(QUERIES[name](spark, SF), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_text_chunks_hold_all_words(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["text_chunks"](spark, SF).collect():
        got.setdefault(int(r.path.split("/")[1].split(".")[0]), []).append((int(r.name.split("_")[1]), r.code))
    for i, text in docs.items():
        assert "".join("".join(c for _, c in sorted(got.get(i, []))).split()) == "".join(text.split())
