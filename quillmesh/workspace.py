"""Where intermediate tables are kept.

Iterative operators cut their lineage by writing a table into the folder that
the cluster names in ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session.

    Read from ``spark.checkpoint.dir`` or from the context's checkpoint folder.
    Only a local master gets a temporary folder when neither is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark).rstrip('/')}/quillmesh-{app}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` has made, once all that is made of it is stored: disk is free again before the job ends."""
    _deleted(table.sparkSession, table._stored_at)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has stored in the shared folder."""
    app = spark.sparkContext.applicationId
    _deleted(spark, f"{shared_root(spark).rstrip('/')}/quillmesh-{app}")


def regrouped(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` without the knowledge that it is partitioned by ``keys`` already.

    What an aggregation makes is partitioned by its keys, so a join on them
    reads the other side into the same partitions, which adaptive execution
    can't split where a key is frequent. With an exchange of its own before the
    join, a few bytes for each key, it can.
    """
    same = {"long": lambda c: c.bitwiseXOR(F.lit(0).cast("long")), "binary": lambda c: F.concat(c, F.lit(b"")), "string": lambda c: F.concat(c, F.lit(""))}
    kinds = {"bigint": "long"} | {k: k for k in same}
    types = dict(df.dtypes)
    return df.withColumns({k: same[kinds[types[k]]](F.col(k)) for k in keys})


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, unless they find it where the driver does."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(context, "_quillmesh_shipped", False) or (root / "quillmesh").is_dir() and str(root) in map(os.path.realpath, filter(None, known)):
        return
    archive = Path(tempfile.mkdtemp(prefix="quillmesh-"), "quillmesh.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "quillmesh").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    context._quillmesh_shipped = True
