import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.models import StubClient, completion, estimated_tokens
from quillmesh.sources import annotations, index_store, repositories
from quillmesh.streaming import index_stream


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "b.bin").write_text("y")
    rows = repositories.read_files(spark, str(tmp_path))
    assert {(r.path, r.content) for r in rows.collect()} == {("src/a.py", "x = 1"), ("b.bin", "y")}
    assert [r.path for r in repositories.indexable_files(rows).collect()] == ["src/a.py"]
    assert repositories.require_whole(rows, F.lit(False)).count() == 2
    with pytest.raises(Exception, match="truncated"):
        repositories.require_whole(rows, F.lit(True)).collect()


def test_store(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, code string")
    index_store.save(one, path, "r1", "s1", "m")
    index_store.save(one.limit(1), path, "r2", "s9", "m")
    index_store.save(one.where("id = 'b'"), path, "r1", "s2", "m")
    assert [r.id for r in index_store.load(spark, path, "r1", "s2", "m").collect()] == ["b"] and index_store.load(spark, path, "r2").count() == 1
    assert index_store.load(spark, path, "r1", "s1").count() == 0 and index_store.load(spark, path, "r1", model="other").count() == 0
    index_store.save(one.where("id = 'z'"), path, "r2", "s10", "m")
    assert index_store.load(spark, path, "r2").count() == 0 and index_store.load(spark, path, "r1").count() == 1
    index_store.clear(spark, path, "r1")
    assert not list((tmp_path / "index").glob("repo=*"))
    done = one.select(F.col("id").alias("path")).limit(1)
    assert index_store.pending(one.withColumnRenamed("id", "path"), done).count() == 1
    assert index_store.same_model("m", "m") and not index_store.same_model(None, "m")


def test_streams_of_replies(spark):
    lines = spark.createDataFrame([(1, 0, '{"type":"chunk","text":"a"}'), (1, 1, '{"type":"chunk","text":"b"}'), (1, 2, "broken"), (2, 0, '{"type":"error","error":"no"}')], "id int, n int, value string")
    got = {r.id: (r.text, r.error) for r in repositories.ndjson_text(lines).collect()}
    assert got == {1: ("ab", None), 2: ("", "no")}
    sse = spark.createDataFrame([("data: {}",), (": ping",), ("data: [DONE]",)], "value string")
    assert [r.data for r in repositories.sse_data(sse).collect()] == ["{}"]


def test_evaluation_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Language,Query,GitHubUrl,Relevance\nPython,q1,u,2\nPython,q1,v,0\nPython,q2,w,1\nJava,q1,x,3\n")
    got = annotations.annotated(annotations.read_annotations(spark, str(tmp_path / "a.csv")), "python", 1, 1).collect()
    assert [(r["query"], r.positives, r.judged) for r in got] == [("q1", 1, 2)]
    doc = {"queries": [{"id": "q", "query": "x", "embedding": [1.0], "relevantIds": ["c"], "relevanceScores": {"c": 9}}], "chunks": [{"id": "c", "query_id": "q", "relevance": 2, "code": "def foo():\n  pass", "embedding": [1.0], "language": "Python"}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    q, c, r = annotations.read_eval_set(spark, str(tmp_path / "e.json"))
    assert c.first().name == "foo" and c.first().filePath == "eval/c.py" and r.first().relevance == 3 and q.count() == 1


def test_models(spark):
    run = completion(lambda: StubClient({"hi": "hello"}))
    assert [r[0] for r in spark.createDataFrame([("hi you",), (None,)], "p string").select(run("p")).collect()] == ["hello", ""]
    assert spark.range(1).select(estimated_tokens(F.lit("x" * 10))).first()[0] == 3


def test_change_stream(spark, tmp_path):
    base = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2")], "path string, sha string")
    src, schema = str(tmp_path / "in"), "filename string, status string, previous_filename string"
    spark.createDataFrame([("a.ts", "modified", None), ("b.ts", "removed", None), ("c.ts", "added", None)], schema).coalesce(1).write.json(src)
    fresh = lambda s, ops: s.createDataFrame([("a.ts", "1x"), ("c.ts", "3"), ("d.ts", "4")], "path string, sha string")
    stream = spark.readStream.schema(schema).json(src)
    index_stream.follow_changes(stream, base, fresh, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    index = str(tmp_path / "index")
    assert {tuple(r) for r in index_stream.current(spark, index).collect()} == {("a.ts", "1x"), ("c.ts", "3")}
    # more batches, one of them merged into a whole table
    later = lambda s, ops: s.createDataFrame([("a.ts", "2x"), ("c.ts", "4")], "path string, sha string")
    for change in [("a.ts", "modified", None), ("c.ts", "removed", None)]:
        spark.createDataFrame([change], schema).coalesce(1).write.mode("append").json(src)
        index_stream.follow_changes(stream, base, later, index, str(tmp_path / "ck"), merge_every=2).awaitTermination()
    assert {tuple(r) for r in index_stream.current(spark, index).collect()} == {("a.ts", "2x")}
    assert {tuple(r) for r in index_stream.current(spark, index, 0).collect()} == {("a.ts", "1x"), ("c.ts", "3")}
    assert index_stream.committed(spark, index, "base") == [-1, 1] and index_stream.committed(spark, index, "changes") == [0, 1, 2]


def test_a_batch_that_dies_at_any_write_isn_t_seen_and_runs_again(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    schema = "filename string, status string, previous_filename string"
    batch = spark.createDataFrame([("a.ts", "modified", None), ("c.ts", "added", None)], schema)
    base = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2")], "path string, sha string")
    fresh = lambda s, ops: s.createDataFrame([("a.ts", "1x"), ("c.ts", "3")], "path string, sha string")
    whole, write, put = {("a.ts", "1x"), ("b.ts", "2"), ("c.ts", "3")}, DataFrameWriter.parquet, index_stream.commit
    for k in range(8):  # four tables are written and four lines: base, touched, rows, base again
        index, steps = str(tmp_path / f"i{k}"), iter(range(100))

        def dying(f):
            def run(*a, **b):
                if next(steps) == k:
                    raise OSError("killed")
                return f(*a, **b)

            return run

        monkeypatch.setattr(DataFrameWriter, "parquet", dying(write))
        monkeypatch.setattr(index_stream, "commit", dying(put))
        failed = False
        try:
            index_stream.apply_batch(batch, 0, base, fresh, index, merge_every=1)
        except OSError:
            failed = True
        monkeypatch.setattr(DataFrameWriter, "parquet", write)
        monkeypatch.setattr(index_stream, "commit", put)
        if failed and index_stream.committed(spark, index, "base"):
            assert {tuple(r) for r in index_stream.current(spark, index).collect()} in ({("a.ts", "1"), ("b.ts", "2")}, whole)
        for _ in range(2):  # again, and once more for nothing
            index_stream.apply_batch(batch, 0, base, fresh, index, merge_every=1)
            assert {tuple(r) for r in index_stream.current(spark, index).collect()} == whole
    assert not failed or k < 7


def test_half_written_folders_are_not_read(spark, tmp_path):
    index = tmp_path / "index"
    (index / "base/v=-1").mkdir(parents=True)
    (index / "touched/v=0").mkdir(parents=True)
    base = spark.createDataFrame([("a.ts", "1")], "path string, sha string")
    batch = spark.createDataFrame([("a.ts", "removed", None)], "filename string, status string, previous_filename string")
    index_stream.apply_batch(batch, 0, base, lambda s, ops: base, str(index))
    assert index_stream.current(spark, str(index)).count() == 0


class Killed(Exception):
    pass


def test_a_staged_build_ends_with_the_same_index_wherever_it_was_killed(spark, tmp_path):
    from quillmesh.sources.staged import StagedIndex

    files = spark.createDataFrame([(f"f{i}.ts", f"text {i}") for i in range(12)], "path string, content string")
    chunk = lambda df: df.select("path", F.concat("path", F.lit("::0")).alias("id"), F.col("content").alias("code"))
    embed = lambda df: df.withColumn("v", F.array(F.length("code").cast("double")))
    want = sorted(map(tuple, embed(chunk(files)).collect()))
    for kill in range(5):
        calls = iter(range(100))

        def counted(f, calls=calls, kill=kill):
            def run(df):
                if next(calls) == kill:
                    raise Killed
                return f(df)

            return run

        index = StagedIndex(spark, str(tmp_path / f"i{kill}"), "s1", "m", parts=2)
        try:
            index.build(files, counted(chunk), counted(embed))
            assert kill == 4
        except Killed:
            assert not index.whole() and sum(r.done for r in index.progress().collect()) == kill
            with pytest.raises(ValueError, match="isn't whole"):
                index.read()
            again = []
            index.build(files, lambda df: again.append(1) or chunk(df), lambda df: again.append(1) or embed(df))
            assert len(again) == 4 - kill  # what was committed isn't done again
        assert sorted(map(tuple, index.read().collect())) == want
    # an addition, twice; another model takes nothing over; folders without a commit go
    more = spark.createDataFrame([("n.ts", "new")], "path string, content string")
    for _ in range(2):
        assert index.append(more, chunk, embed, "add-a").count() == 13
    assert [(r.stage, r.parts, r.done, r["rows"]) for r in index.progress().collect()] == [("chunking", 4, 4, 13), ("embedding", 4, 4, 13)]
    assert not StagedIndex(spark, index.path, "s1", "other", parts=2).whole()
    more.write.parquet(f"{index.path}/embedding-0-dead")
    assert "embedding-0-dead" in index.vacuum() and index.read().count() == 13


def git(path, *args):
    import subprocess

    subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", "-c", "init.defaultBranch=main", *args], check=True, capture_output=True)


@pytest.fixture
def repository(tmp_path):
    path = tmp_path / "code"
    (path / "src").mkdir(parents=True)
    git(path, "init")
    (path / "src/a.ts").write_text("export const a = 1\n" * 5)
    (path / "ünï code.py").write_text("x = 'é'\n")
    (path / "raw.bin").write_bytes(b"\xff\xfe\x00")
    (path / "big.txt").write_text("y" * 5000)
    git(path, "add", ".")
    git(path, "commit", "-m", "one")
    return path


def test_snapshot_files(spark, repository):
    from quillmesh.sources import snapshots

    snapshots.register(spark)
    read = lambda **o: spark.read.format("git_snapshot").options(**o).load(str(repository))
    rows = {r.path: r for r in read(bytes=1000, files=2).collect()}
    assert {p: (r.content, r.error) for p, r in rows.items()} == {"src/a.ts": ("export const a = 1\n" * 5, None), "ünï code.py": ("x = 'é'\n", None), "raw.bin": (None, "not text"), "big.txt": (None, "larger than 1000 bytes")}
    first = snapshots.resolved(str(repository), "HEAD")
    assert {(r.repo, r.snapshot, r.truncated) for r in rows.values()} == {("code", first, False)}
    cut = read(limit=2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)
    with pytest.raises(Exception, match="truncated"):
        repositories.require_whole(read(limit=2), F.col("truncated")).collect()
    (repository / "src/a.ts").write_text("changed")
    git(repository, "commit", "-am", "two")
    assert {r.content for r in read(ref=first).where("path = 'src/a.ts'").collect()} == {"export const a = 1\n" * 5}
    assert read().where("path = 'src/a.ts'").first().content == "changed"
    # objects that are gone: a few rows say so, more fail
    sha = rows["src/a.ts"].sha
    (repository / ".git/objects" / sha[:2] / sha[2:]).unlink()
    assert read(ref=first).where("path = 'src/a.ts'").first().error == "missing"
    with pytest.raises(Exception, match="can't be read"):
        read(ref=first, failures=0).collect()
    with pytest.raises(Exception, match="rev-parse"):
        read(ref="nowhere").collect()


def test_a_snapshot_stream_stops_and_goes_on(spark, repository, tmp_path):
    from quillmesh.sources import snapshots

    snapshots.register(spark)
    out, check = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.format("git_changes").load(str(repository))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return {(r.filename, r.status, r.previous_filename, r.snapshot) for r in spark.read.parquet(out).collect()}

    seen = run()
    assert {(f, s) for f, s, _, _ in seen} == {(f, "added") for f in ("src/a.ts", "ünï code.py", "raw.bin", "big.txt")}
    git(repository, "mv", "src/a.ts", "src/b.ts")
    (repository / "big.txt").write_text("z")
    git(repository, "rm", "raw.bin")
    (repository / "new.go").write_text("package n")
    git(repository, "add", ".")
    git(repository, "commit", "-m", "two")
    more = run() - seen
    assert {x[:3] for x in more} == {("src/b.ts", "renamed", "src/a.ts"), ("big.txt", "modified", None), ("raw.bin", "removed", None), ("new.go", "added", None)}
    assert {x[3] for x in more} == {snapshots.resolved(str(repository), "HEAD")}
    assert run() == seen | more  # nothing new


def test_an_index_follows_a_repository(spark, repository, tmp_path):
    """From a snapshot, by the stream of its changes, to the index of the next one."""
    from quillmesh.sources import snapshots

    snapshots.register(spark)
    index, check = str(tmp_path / "index"), str(tmp_path / "ck")
    none = spark.createDataFrame([], "path string, sha string")
    fresh = lambda s, ops: s.read.format("git_snapshot").load(str(repository)).select("path", "sha")

    def follow():
        stream = spark.readStream.format("git_changes").load(str(repository))
        index_stream.follow_changes(stream, none, fresh, index, check).awaitTermination()
        return {tuple(r) for r in index_stream.current(spark, index).collect()}

    wanted = lambda: {tuple(r) for r in repositories.indexable_files(fresh(spark, None)).select("path", "sha").collect()}
    assert follow() == wanted()
    git(repository, "mv", "src/a.ts", "src/b.ts")
    (repository / "src/c.ts").write_text("c")
    git(repository, "add", ".")
    git(repository, "commit", "-m", "two")
    assert follow() == wanted() and len(wanted()) >= 2


def test_event_stream(spark, tmp_path):
    schema = "id long, ts timestamp, type string, durationMs long, provider string, tokensIn long, tokensOut long, chunks int, files int, blocked boolean, redactedChunks int"
    spark.range(10).select("id", F.timestamp_seconds("id").alias("ts"), F.lit("search").alias("type"), F.lit(2).cast("long").alias("durationMs"), *[F.lit(None).cast(t).alias(n) for n, t in (("provider", "string"), ("tokensIn", "long"), ("tokensOut", "long"), ("chunks", "int"), ("files", "int"), ("blocked", "boolean"), ("redactedChunks", "int"))]).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = index_stream.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals_now").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals_now").first().search_calls == 10
    q = index_stream.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows_now").trigger(availableNow=True).start()
    q.awaitTermination()
