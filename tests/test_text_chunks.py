"""Chunks of documents against their SQL, on tables with odd rows."""

import pytest

from quillmesh import catalog
from quillmesh.operators import chunking

LONG = "w" * 2_040
CASES = {
    "a text of more characters than are cut": [(1, "a" * 120_000, "s"), (2, "a" * 120_001, "s"), (3, "é" * 120_000, "s"), (4, "é" * 120_001, "s"), (5, "p\n\n" * 40_001, "s")],
    "no path": [(1, "abc", None), (None, "abc", "s"), (3, "abc", ""), (4, None, "s"), (5, "", "s")],
    "blanks that aren't ASCII stay": [(1, "\xa0abc　", "s"), (2, "abc\n\n" + "\x85" * 2_100, "s"), (3, "\x1cabc\x1f\n", "s"), (4, "\v\f abc \v", "s")],
    "a boundary is judged by its line": [(1, f"{LONG}\nconst x\n={LONG}", "s"), (2, f"{LONG}\nconst\nx ={LONG}", "s"), (3, f"{LONG}\nasync\nfunction f{LONG}", "s"), (4, f"{LONG}\nconst x ={LONG}", "s"), (5, f"{LONG}\nclass\n{LONG}", "s")],
    "a boundary is judged by ASCII": [(1, f"{LONG}\nclass\xa0{LONG}", "s"), (2, f"{LONG}\nconst é ={LONG}", "s"), (3, f"{LONG}\ndef\v{LONG}", "s"), (4, f"{LONG}\n## {LONG}", "s"), (5, f"{LONG}\ntype\t{LONG}", "s")],
}


@pytest.mark.parametrize("case", CASES)
def test_rows_equal_those_of_sql(spark, tmp_path, case):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(CASES[case], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["text_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES['text_chunks']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected) and expected


def test_a_file_that_is_not_cut_keeps_its_summary(spark):
    rows = spark.createDataFrame([("s/1.txt", "a" * 120_001), ("s/2.txt", "a")], "path string, content string")
    assert {r.id for r in chunking.chunk_files(rows).collect()} == {"s/1.txt::large_file_summary", "s/2.txt::chunk_0"}
