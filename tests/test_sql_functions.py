"""What ``spark.sql`` gives by the registered functions, against the column functions."""

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import sql, text, vectors
from quillmesh.operators import chunking, extract

TEXTS = ["getUserName of the HTTPServer_v2", "it's the\t\n src/lib/a.ts line 42, wasn't it?", "", None, "é naïve αβγ ", " \t\n\r\x0b\x0c x \x0b", "a" * 50 + "_b" * 20]


@pytest.fixture(scope="module")
def frame(spark):
    sql.register(spark)
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").createOrReplaceTempView("texts")
    spark.createDataFrame([(0, [1.0, -2.0, 0.5], [3.0, 4.0]), (1, [], [1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [float((-1) ** i * i) for i in range(70)], [float(i % 7 - 3) for i in range(70)])], "id int, a array<double>, b array<double>").createOrReplaceTempView("vectors")
    return spark


@pytest.mark.parametrize("name, column", [("code_tokens", text.code_tokens), ("query_symbols", text.query_symbols), ("evidence_terms", text.evidence_terms), ("summary_tokens", text.summary_tokens), ("text_words", text.words), ("blank_trimmed", text.trimmed)])
def test_text_functions(frame, name, column):
    assert frame.sql(f"SELECT id, {name}(t) AS x FROM texts ORDER BY id").collect() == frame.table("texts").select("id", column(F.col("t")).alias("x")).orderBy("id").collect()


def test_vector_functions(frame):
    a, b = F.col("a"), F.col("b")
    bits = lambda v: vectors.binarized(v)
    want = frame.table("vectors").select("id", vectors.dot(a, b).alias("d"), vectors.cosine(a, b).alias("c"), vectors.l2_normalized(a).alias("n"), bits(a).alias("s"), vectors.hamming(bits(a), bits(b)).alias("h")).orderBy("id")
    got = frame.sql("SELECT id, dot(a, b) AS d, cosine(a, b) AS c, l2_normalized(a) AS n, sign_bits(a) AS s, hamming(sign_bits(a), sign_bits(b)) AS h FROM vectors ORDER BY id")
    assert got.collect() == want.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UserDefined" not in plan  # inlined


def test_table_functions(frame):
    long_ = "para one\n\npara two is longer\n\n" * 40
    frame.createDataFrame([(1, long_), (2, ""), (3, None)], "id int, t string").createOrReplaceTempView("long_texts")
    got = frame.sql("SELECT id, c.code, c.first_line, c.last_line FROM long_texts, LATERAL text_chunks(t, 200) c ORDER BY first_line").collect()
    assert [tuple(r)[1:] for r in got] == chunking.chunk_text(long_, 200) and {r.id for r in got} == {1}
    got = frame.sql("SELECT w.code FROM long_texts, LATERAL text_windows(t, 30, 60, 10) w WHERE id = 1 ORDER BY number").collect()
    assert [r.code for r in got] == chunking.window_lines(long_, 30, 60, 10)
    code = "import a from './a';\nclass C {\n  m() { }\n}\n"
    frame.createDataFrame([("x.ts", code), ("y.py", "import os\ndef f():\n    pass\n"), ("z", None)], "path string, content string").createOrReplaceTempView("code")
    rows = frame.sql("SELECT path, d.* FROM code, LATERAL code_definitions(content, CASE WHEN endswith(path, '.py') THEN 'python' ELSE 'typescript' END) d ORDER BY path, first_line").collect()
    assert [tuple(r) for r in rows] == [("x.ts", *d) for d in extract.code_parts(code, "typescript")[2]] + [("y.py", "f", "function_definition", 2, 3, -1)]
    rows = frame.sql("SELECT path, i.import FROM code, LATERAL code_imports(content, CASE WHEN endswith(path, '.py') THEN 'python' ELSE 'typescript' END) i ORDER BY path").collect()
    assert [tuple(r) for r in rows] == [("x.ts", "./a"), ("y.py", "os")]


def test_an_index_can_be_made_in_sql_alone(frame):
    from quillmesh.operators.bm25 import term_counts

    got = frame.sql("SELECT id, c.term, c.tf FROM (SELECT id, code_tokens(t) AS tokens FROM texts), LATERAL term_counts(tokens) c").collect()
    want = term_counts(frame.table("texts"), "id", "t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
