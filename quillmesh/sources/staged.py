"""Building an index by stages that can be resumed, and adding to one.

Files are dealt into parts by a hash of their paths. Each part is chunked, then
embedded; what a stage makes of a part is a table in a folder of its own and one
commit. A build that is killed between two stages or inside one goes on with the
parts that lack a commit and ends with the same rows. Commits carry the snapshot
and the model, so a build of another snapshot or model takes nothing over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.commits import commit, drop, leftovers, log

STAGES = ("chunking", "embedding")


class StagedIndex:
    """The index of a repository at ``path``, for one snapshot and one model of embedding."""

    def __init__(self, spark: SparkSession, path: str, snapshot: str, model: str, parts: int = 8):
        self.spark, self.path, self.snapshot, self.model, self.parts = spark, path, snapshot, model, parts

    def _done(self) -> dict[tuple[str, str], dict]:
        """Commits of this snapshot and model by stage and part."""
        mine = (c for c in log(self.spark, self.path).values() if (c["snapshot"], c["model"]) == (self.snapshot, self.model))
        return {(c["stage"], c["part"]): c for c in mine}

    def _wanted(self, adds: str) -> list[str]:
        return [f"{adds}{i}" for i in range(self.parts)]

    def _write(self, rows: DataFrame, stage: str, part: str) -> None:
        folder = f"{stage}-{part}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        name = F.md5(F.concat_ws("\n", *(F.lit(x) for x in (self.snapshot, self.model, stage, part))))
        key = self.spark.range(1).select(name).first()[0]
        commit(self.spark, self.path, key, {"stage": stage, "part": part, "snapshot": self.snapshot, "model": self.model, "folder": folder, "rows": n, "parts": self.parts})

    def _run(self, files: DataFrame, chunk: Callable, embed: Callable, adds: str) -> None:
        done = self._done()
        number = F.pmod(F.xxhash64("path"), F.lit(self.parts))
        for i, part in enumerate(self._wanted(adds)):
            if ("chunking", part) not in done:
                self._write(chunk(files.where(number == i)), "chunking", part)
        done = self._done()
        for part in self._wanted(adds):
            if ("embedding", part) not in done:
                self._write(embed(self.spark.read.parquet(f"{self.path}/{done['chunking', part]['folder']}")), "embedding", part)

    def build(self, files: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Chunk and embed ``files`` (with their ``path``), from where an earlier build of the same snapshot and model has stopped."""
        self._run(files, chunk, embed, "")
        return self.read()

    def append(self, files: DataFrame, chunk: Callable, embed: Callable, name: str) -> DataFrame:
        """Add files under a name of the addition; the same name again, after a kill or as a whole, adds nothing twice."""
        if not name or name[-1].isdigit():
            raise ValueError("an addition's name doesn't end in a digit, as the numbers of parts follow it")
        self._run(files, chunk, embed, name)
        return self.read()

    def progress(self) -> DataFrame:
        """``stage, parts, done, rows`` of each stage: the row that says where a build stands."""
        done = self._done()
        adds = {p.rstrip("0123456789") for _, p in done} | {""}
        rows = [(s, self.parts * len(adds), sum(k[0] == s for k in done), sum(c["rows"] for k, c in done.items() if k[0] == s)) for s in STAGES]
        return self.spark.createDataFrame(rows, "stage string, parts int, done int, rows long")

    def whole(self) -> bool:
        """Whether all parts of the build and of its additions are embedded."""
        done = self._done()
        return all(("embedding", p) in done for adds in {p.rstrip("0123456789") for _, p in done} | {""} for p in self._wanted(adds))

    def read(self) -> DataFrame:
        """The rows of a whole index; of a part of one there is nothing to read."""
        if not self.whole():
            raise ValueError(f"the index of {self.snapshot} isn't whole; build() goes on with it")
        folders = [c["folder"] for (s, _), c in sorted(self._done().items()) if s == "embedding"]
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{f}") for f in folders))

    def vacuum(self) -> list[str]:
        """Delete the folders that no commit names, and those of chunks that are embedded."""
        done = self._done()
        keep = {c["folder"] for c in log(self.spark, self.path).values()} - {c["folder"] for (s, p), c in done.items() if s == "chunking" and ("embedding", p) in done}
        gone = leftovers(self.spark, self.path, keep)
        drop(self.spark, self.path, gone)
        return gone
