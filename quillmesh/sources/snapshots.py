"""Snapshots of git repositories as a data source, in batches and as a stream.

    register(spark)
    spark.read.format("git_snapshot").load("/shared/repo.git")
    spark.readStream.format("git_changes").option("ref", "main").load("/shared/repo.git")

A batch read pins the commit that ``ref`` names when it is planned: all tasks
list and read that commit, whatever is pushed meanwhile. A stream's offset is
the commit, so a restart goes on from the last one that was processed, and the
changes of a batch are those between two commits. The repository's folder has to
be one that all executors see.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Options: the most files of a listing, files in a partition, files of a partition that may fail before the read does, and the largest file that is read, in bytes.
DEFAULTS = {"ref": "HEAD", "limit": "100000", "files": "2000", "failures": "20", "bytes": str(10 << 20), "repo": ""}
_FILES = "repo string, path string, size long, sha string, snapshot string, truncated boolean, content string, error string"
_CHANGES = "repo string, filename string, status string, previous_filename string, snapshot string"
#: What the letters of a comparison stand for.
STATUS = {"A": "added", "M": "modified", "D": "removed", "R": "renamed", "C": "added", "T": "modified"}


def _git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed in {path}: {done.stderr.decode(errors='replace').strip()[:500]}")
    return done.stdout


def resolved(path: str, ref: str) -> str:
    """The commit that a name stands for now."""
    return _git(path, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


def listing(path: str, commit: str) -> list[tuple[str, int, str]]:
    """``path, size, sha`` of the files of a commit, by path; links to other repositories aren't files."""
    rows = []
    for line in _git(path, "ls-tree", "-r", "-l", "-z", commit).split(b"\0"):
        if line:
            what, name = line.split(b"\t", 1)
            _, kind, sha, size = what.split()
            if kind == b"blob":
                rows.append((name.decode(errors="replace"), int(size) if size.isdigit() else 0, sha.decode()))  # the size of what is missing is unknown
    return sorted(rows)


def changes(path: str, before: str, after: str) -> list[tuple[str, str, str | None]]:
    """``filename, status, previous_filename`` between two commits; with no first one all files are added."""
    if not before:
        return [(name, "added", None) for name, _, _ in listing(path, after)]
    out, parts = [], iter(_git(path, "diff-tree", "-r", "-z", "-M", "--name-status", before, after).split(b"\0"))
    for letter in parts:
        if letter:
            status = STATUS.get(letter[:1].decode(), "changed")
            first = next(parts).decode(errors="replace")
            second = next(parts).decode(errors="replace") if letter[:1] in (b"R", b"C") else None
            out.append((second or first, status, first if status == "renamed" else None))
    return out


def _blobs(path: str, shas: list[str]) -> Iterator[bytes | None]:
    """The contents of files one after the other, by one process; None for what the repository doesn't have."""
    run = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        for sha in shas:
            run.stdin.write(f"{sha}\n".encode())
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) < 3:
                yield None
                continue
            data = run.stdout.read(int(head[2]))
            run.stdout.read(1)
            yield data
    finally:
        run.stdin.close()
        run.stdout.close()
        run.wait()


@dataclass
class Part(InputPartition):
    """Rows ``first`` to ``last`` of the listing of a commit, or of its changes since another."""

    commit: str
    first: int
    last: int
    before: str = ""


def _parts(n: int, each: int, commit: str, before: str = "") -> list[Part]:
    return [Part(commit, at, min(at + each, n), before) for at in range(0, n, each)] or [Part(commit, 0, 0, before)]


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[Part]:
        commit = resolved(self.o["path"], self.o["ref"])
        n = min(len(listing(self.o["path"], commit)), int(self.o["limit"]))
        return _parts(n, int(self.o["files"]), commit)

    def read(self, part: Part) -> Iterator[tuple]:
        o, every = self.o, listing(self.o["path"], part.commit)
        truncated, rows, failed = len(every) > int(o["limit"]), every[part.first : part.last], 0
        read = [sha for _, size, sha in rows if size <= int(o["bytes"])]
        held = _blobs(o["path"], read)
        for name, size, sha in rows:
            content, error = None, None
            if size > int(o["bytes"]):
                error = f"larger than {o['bytes']} bytes"
            elif (data := next(held)) is None:
                error, failed = "missing", failed + 1
            else:
                try:
                    content = data.decode()
                except UnicodeDecodeError:
                    error = "not text"
            if failed > int(o["failures"]):
                raise RuntimeError(f"{failed} files of {o['path']} at {part.commit} can't be read; the first rows of this part begin with {rows[0][0]}")
            yield (o["repo"], name, size, sha, part.commit, truncated, content, error)


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = options

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        return {"sha": resolved(self.o["path"], self.o["ref"])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if start["sha"] == end["sha"]:
            return []
        return _parts(len(changes(self.o["path"], start["sha"], end["sha"])), int(self.o["files"]), end["sha"], start["sha"])

    def read(self, part: Part) -> Iterator[tuple]:
        for name, status, previous in changes(self.o["path"], part.before, part.commit)[part.first : part.last]:
            yield (self.o["repo"], name, status, previous, part.commit)


class GitSnapshots(DataSource):
    """Files of a commit: ``repo, path, size, sha, snapshot, truncated, content, error``.

    Options: ``ref``, ``repo`` (a name for the rows), ``limit`` of files, beyond
    which the listing is cut and says so in ``truncated``, ``files`` in a
    partition, ``bytes`` of the largest file that is read, and ``failures`` that
    a partition may have before the read fails. A file that isn't UTF-8, is too
    large or is missing has no content and says why in ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def _options(self) -> dict:
        own = DEFAULTS | {k.lower(): v for k, v in self.options.items()}
        if not own.get("path"):
            raise ValueError("load() needs the folder of a repository")
        own["path"] = own["path"].removeprefix("file://").removeprefix("file:")
        own["repo"] = own["repo"] or own["path"].rstrip("/").rpartition("/")[2].removesuffix(".git")
        return own

    def schema(self) -> str:
        return _FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files(self._options())


class GitChanges(GitSnapshots):
    """Changes from commit to commit, as a stream: ``repo, filename, status, previous_filename, snapshot``; at first all files are added."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return _CHANGES

    def reader(self, schema: StructType) -> DataSourceReader:
        raise NotImplementedError("changes are a stream; two tables are compared by operators.incremental")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Changes(self._options())


def register(spark) -> None:
    """Make the formats ``git_snapshot`` (batch) and ``git_changes`` (stream) known to a session."""
    spark.dataSource.register(GitSnapshots)
    spark.dataSource.register(GitChanges)
