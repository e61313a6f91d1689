import json

from pyspark.sql import functions as F

from quillmesh.operators import messages


def test_normalized(spark):
    good = {"role": "user", "content": "hi", "citations": [{"filePath": "a", "startLine": -2.5, "endLine": 3.9, "score": 0.5, "chunkCount": 0}, {"filePath": "b"}], "safety": {"signals": ["x", ""] + list("abcdefghij")}}
    rows = [(1, json.dumps([good, {"role": "robot", "content": "x"}, {"role": "assistant"}])), (2, "broken"), (3, None), (4, json.dumps([{"role": "user", "content": str(i)} for i in range(60)])), (5, json.dumps({"messages": [good]}))]
    got = {r.k: r.m for r in messages.normalized(spark.createDataFrame(rows, "k int, p string"), "k", "p").withColumnRenamed("messages", "m").collect()}
    assert len(got[1]) == 1 and got[1][0].id == "m0" and [tuple(c) for c in got[1][0].citations] == [("a", 1, 3, 0.5, 1)] and len(got[1][0].signals) == 8
    assert not got[2] and not got[3] and [m.content for m in got[4]] == [str(i) for i in range(10, 60)] and len(got[5]) == 1


def test_links(spark):
    text = "see src/a b.ts and `src/a.ts`, not ```src/a.ts``` or [x](src/a.ts)"
    got = messages.linked(text, ["src/a.ts", "src/a b.ts", "a.ts"], "o", "r", "c")
    assert got == "see [src/a b.ts](https://github.com/o/r/blob/c/src/a%20b.ts) and [`src/a.ts`](https://github.com/o/r/blob/c/src/a.ts), not ```src/a.ts``` or [x](src/a.ts)"
    assert messages.linked(text, [], "o", "r", "c") == text
    row = spark.createDataFrame([(text, ["src/a.ts"]), (None, None)], "t string, p array<string>").select(messages.with_links("t", "p", F.lit("o"), F.lit("r"), F.lit("c")).alias("x")).collect()
    assert "[`src/a.ts`](" in row[0].x and row[1].x is None


def test_picks(spark):
    shown = F.array(*map(F.lit, "abcd"))
    rows = spark.createDataFrame([('take ["b", "z"]',), ('"c" and "d" [broken',), (None,), ("nothing",)], "r string")
    assert [r[0] for r in rows.select(messages.picked(F.col("r"), shown, 2)).collect()] == [["b"], ["c", "d"], ["a", "b"], ["a", "b"]]


def test_settings_are_kept(spark):
    rows = [{"role": "user", "content": "a", "ui": {"sourcesExpanded": True}, "safety": {"blocked": True, "reason": "why"}}, {"role": "user", "content": "b", "ui": {"sourcesExpanded": "yes"}, "safety": {"reason": ""}}]
    got = messages.normalized(spark.createDataFrame([(1, json.dumps(rows[:1])), (2, json.dumps(rows[1:]))], "k int, p string"), "k", "p").orderBy("k").collect()
    assert [(r.messages[0].sources_expanded, r.messages[0].blocked, r.messages[0].reason) if r.messages else None for r in got] == [(True, True, "why"), got[1].messages and (None, None, None) or None]


def test_sessions_and_their_older_form(spark):
    said = [{"role": "assistant", "content": "hi"}, {"role": "user", "content": "  what   is\nthis "}]
    states = {
        "old": json.dumps(said), "long": json.dumps([{"role": "user", "content": "x" * 50}]), "broken": "{", "none": None, "empty": "[]", "bare": json.dumps({"sessions": []}),
        "new": json.dumps({"activeChatId": "b", "sessions": [{"chat_id": "a", "messages": said, "updatedAt": 5}, {"title": "no id"}, {"chat_id": "b", "title": "named", "messages": "nothing"}, {"chat_id": "c", "messages": [{"role": "robot", "content": "x"}]}]}),
        "lost": json.dumps({"activeChatId": "zz", "sessions": [{"chat_id": "a", "title": "t"}]}),
    }
    got = {}
    for r in messages.sessions(spark.createDataFrame(list(states.items()), "k string, p string"), "k", "p").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.chat_id, r.title, r.updated_at, len(r.messages), r.active))
    fresh = [("fresh", "Chat 1", None, 0, True)]
    assert got["old"] == [("legacy", "what is this", None, 2, True)] and got["long"] == [("legacy", "x" * 40 + "...", None, 1, True)]
    assert all(got[k] == fresh for k in ("broken", "none", "empty", "bare"))
    assert got["new"] == [("a", "what is this", 5.0, 2, False), ("b", "named", None, 0, True), ("c", "Chat 3", None, 0, False)]
    assert got["lost"] == [("a", "t", None, 0, True)]
