"""The directory tree, and aggregates that are kept up to date, against plain versions."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import summaries, tree


def plain_tree(paths):
    """(path, parent) of the shown directories, by nested dictionaries."""
    root = {}
    for p in paths:
        at = root
        for part in p.split("/")[:-1]:
            at = at.setdefault(part, {})
        at.setdefault(None, []).append(p)
    out = []

    def walk(node, full, parent):
        while len(node) == 1 and None not in node:
            ((name, node),) = node.items()
            full = f"{full}/{name}" if full else name
        out.append((full, parent))
        for name, child in node.items():
            if name is not None:
                walk(child, f"{full}/{name}" if full else name, full)

    walk(root, "", None)
    return sorted(out, key=str)


def test_chains_of_only_children_are_one_node(spark):
    r = random.Random(1)
    sets = {"deep": ["/".join(f"d{i}" for i in range(12)) + "/x.ts"], "flat": ["a.ts", "b.ts"], "mixed": ["a/b/c.ts", "a/b/d/e/f.ts", "g.ts", "h/i/j/k.ts"]}
    sets["random"] = sorted({"/".join(r.choice("abc") for _ in range(r.randrange(1, 7))) + f"/{r.randrange(3)}.ts" for _ in range(60)})
    rows = [(repo, p, ["done"], 2) for repo, paths in sets.items() for p in paths] + [("deep", None, ["done"], 1)]
    got = tree.directory_tree(spark.createDataFrame(rows, "repo string, path string, states array<string>, chunks int")).collect()
    for repo, paths in sets.items():
        mine = [n for n in got if n.repo == repo]
        assert sorted(((n.path, n.parent) for n in mine if not n.is_file), key=str) == plain_tree(paths)
        assert {n.path for n in mine if n.is_file} == set(paths)
        depth = {n.path: n.depth for n in mine if not n.is_file}
        assert all(n.depth == (depth[n.parent] + 1 if n.parent in depth else 0) for n in mine if not n.is_file)
    (deep,) = [n for n in got if n.repo == "deep" and not n.is_file]
    assert deep.name == deep.path == "/".join(f"d{i}" for i in range(12)) and deep.n_chunks == 2 and deep.parent is None
    places = [(n.is_file, n.name) for n in sorted((n for n in got if n.repo == "mixed" and n.parent == ""), key=lambda n: n.place)]
    assert places == [(False, "a/b"), (False, "h/i/j"), (True, "g.ts")]
    assert tree.directory_tree(spark.createDataFrame([], "repo string, path string, states array<string>, chunks int")).count() == 0


def test_states_roll_up(spark):
    rows = [("r", "a/x.ts", [], 1), ("r", "a/y.ts", ["done"], 1), ("r", "b/x.ts", ["done", "done"], 1), ("r", "b/y.ts", ["done"], None), ("r", "c/x.ts", ["pending"], 1), ("r", "c/y.ts", ["done", "embedding"], 1), ("r", "d/x.ts", ["pending", "done"], 1)]
    got = {n.path: n.status for n in tree.directory_tree(spark.createDataFrame(rows, "repo string, path string, states array<string>, chunks int")).collect()}
    assert [got[p] for p in ("a/x.ts", "a/y.ts", "c/y.ts", "d/x.ts")] == ["parsed", "done", "embedding", "pending"]
    assert [got[p] for p in ("a", "b", "c", "d", "")] == ["parsed", "done", "embedding", "pending", "embedding"]


def test_updates_equal_a_rebuild(spark):
    r = random.Random(7)
    path = lambda: r.choice(["", "a/", "a/b/", "c/"]) + f"{r.randrange(12)}.ts"
    state = {path(): r.randrange(1, 90) for _ in range(25)}
    frame = lambda s: spark.createDataFrame([("r", p, c, 1, False) for p, c in s.items()], "repo string, path string, chars long, chunks int, has_summary boolean")

    def chunks(s):
        rows = [("r", p, i, "text_chunk", f"{p} holds {c}") for i, (p, c) in enumerate(sorted(s.items()))] + [("r", "a/[directory_summary]", -1, "directory_summary", f"about a: {len(s)}")] * (len(s) % 2)
        return spark.createDataFrame(rows, "repo string, path string, ord long, node_type string, code string")

    limits = {"files": 3, "chars": 100, "summary": 500}
    stats, lists, nodes = summaries.directory_stats(frame(state)), summaries.directory_summaries(frame(state), limits), summaries.page_index(chunks(state))
    for _ in range(2):
        after = {p: c for p, c in state.items() if r.random() > 0.2}
        after |= {p: r.randrange(1, 90) for p in (path() for _ in range(4))}
        touched = [p for p in {*state, *after} if state.get(p) != after.get(p)]
        files = spark.createDataFrame([("r", p) for p in [*touched, "a/[directory_summary]"]], "repo string, path string")
        stats = summaries.updated_directory_stats(stats, frame({p: state[p] for p in touched if p in state}), frame({p: after[p] for p in touched if p in after}))
        lists = summaries.updated_directory_summaries(lists, frame(after), files, limits)
        # a file's place in the order is its own, so that those that stay keep theirs
        order = {p: i for i, p in enumerate(sorted({*state, *after}))}
        placed = lambda s: chunks(s).withColumn("ord", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, i in order.items() for x in (p, i)]), F.col("path")).cast("long"), F.lit(-1).cast("long")))
        nodes = summaries.updated_page_index(summaries.page_index(placed(state)), placed(after), files)
        state = after
        rows = lambda df: sorted((tuple(x[c] for c in sorted(df.columns)) for x in df.collect()), key=str)
        assert rows(stats) == rows(summaries.directory_stats(frame(state)))
        assert rows(lists) == rows(summaries.directory_summaries(frame(state), limits))
        assert rows(nodes) == rows(summaries.page_index(placed(state)))
