import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = e.queries()
assert set(e.oracle_sql()) <= set(q)
print("ROWS", q["text_chunks"](spark, "/root/testdata/sf0.001").count())
"""


MISSING = """
import sys; sys.path.insert(0, {root!r})
sys.modules["public_tokenizers"] = None
import __spark_entry__ as e
assert "bm25_topk" in e.queries() and not any(q.startswith("op") for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print("WITHOUT")
"""


def test_a_missing_library_leaves_the_training_data_operators_out(tmp_path):
    out = subprocess.run([sys.executable, "-c", MISSING.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "WITHOUT" in out.stdout, out.stderr[-2000:]


WITHOUT_FOLDER = """
import sys; sys.path.insert(0, {root!r})
for name in {gone!r}:
    sys.modules[name] = None
import __spark_entry__ as e
try:
    print("QUERIES", any(q.startswith("op") for q in e.queries()), "bm25_topk" in e.queries())
except ImportError as x:
    print("ERROR", x.name)
"""


@pytest.mark.parametrize("gone, said", [(("quillmesh.llm", "corpus_pipeline"), "QUERIES False True"), (("corpus_pipeline",), "QUERIES True True"), (("quillmesh.llm.rows",), "ERROR quillmesh.llm.rows")])
def test_only_a_missing_subpackage_or_library_is_passed_over(tmp_path, gone, said):
    out = subprocess.run([sys.executable, "-c", WITHOUT_FOLDER.format(root=str(ROOT), gone=gone)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert said in out.stdout or not (ROOT / "quillmesh/llm").exists(), out.stderr[-2000:]


def test_workers_get_the_package_wherever_the_driver_runs(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
