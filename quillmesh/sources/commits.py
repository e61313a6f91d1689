"""A log of commits beside tables: what isn't in the log doesn't count.

A writer puts its tables into folders that nobody reads yet and then adds one
small file to the log, under a name that can be taken once. A job that dies
before leaves folders without meaning, and one that runs again takes new ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, name: str, what: dict) -> bool:
    """Add ``what`` to the log below ``path`` as ``name``; false if the name is taken, and then nothing changes."""
    at, fs = _fs(spark, f"{path}/_log/{name}.json")
    if fs.exists(at):
        return False
    draft, _ = _fs(spark, f"{path}/_log/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        return False
    return True


def log(spark: SparkSession, path: str) -> dict[str, dict]:
    """What has been committed, by name."""
    at, fs = _fs(spark, f"{path}/_log")
    if not fs.exists(at):
        return {}
    found = {}
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(s.getPath())
            found[name[:-5]] = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            stream.close()
    return found


def leftovers(spark: SparkSession, path: str, keep: set[str]) -> list[str]:
    """Folders of tables below ``path`` that no commit names."""
    at, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return sorted(n for n in names if n != "_log" and n not in keep)


def drop(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete folders below ``path``."""
    for n in names:
        place, fs = _fs(spark, f"{path}/{n}")
        fs.delete(place, True)
