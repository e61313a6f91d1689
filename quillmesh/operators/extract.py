"""Imports, definitions and symbols of source files, and how imports resolve to files.

Python goes through its own parser and the other languages through their tokens
(``operators.lexer``), in Arrow batches. ``graph_columns`` is a rough reading by
patterns in built-in columns alone, which also sees what stands in comments.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import lexer
from quillmesh.operators.paths import language

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def links(html: Column) -> Column:
    """Distinct targets of links of a page."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1)))


def _all(text: Column, *patterns: str) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in patterns]))


def graph_columns(text: Column, language: str) -> tuple[Column, Column]:
    """Imports and definitions of a text in a language, by patterns."""
    none = F.array().cast("array<string>")
    if language in ("javascript", "typescript", "tsx"):
        imports = _all(text, r"""(?m)^\s*import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]""", r"""(?m)^\s*export\s+[^'";]*?\s+from\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]""")
        return imports, _all(text, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=")
    if language == "go":
        return _all(text, r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', r'(?m)^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$'), _all(text, r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", r"(?m)^type\s+(\w+)")
    if language == "rust":
        return _all(text, r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);"), _all(text, r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)")
    if language in ("c", "cpp"):
        return _all(text, r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]'), _all(text, r"(?m)^[A-Za-z_][\w\s*&:<>]*?\b(\w+)\s*\([^;{]*\)\s*\{", r"(?m)^\s*(?:class|struct)\s+(\w+)")
    return none, none


def python_parts(code: str) -> tuple[list[str], list[str], list[tuple[str, str, int, int]]]:
    """Imported modules, definitions, and symbols as name, kind, first and last line; a file that doesn't parse has none."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return [], [], []
    imports, definitions, symbols = [], [], []

    def visit(node, inside_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append("." * child.level + (child.module or ""))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside_class else "function"
                definitions.append(child.name)
                symbols.append((child.name, kind, child.lineno, child.end_lineno or child.lineno))
            visit(child, isinstance(child, ast.ClassDef))

    visit(tree, False)
    return list(dict.fromkeys(imports)), list(dict.fromkeys(definitions)), symbols


_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("code", pa.string())])


def python_graph(files: DataFrame) -> DataFrame:
    """``repo, path, imports, definitions, symbols`` of Python files ``repo, path, content``; a symbol carries its lines, which are its chunk."""

    def run(batches):
        for batch in batches:
            parts, symbols = [], []
            for text in batch.column("content").to_pylist():
                text = text or ""
                parts.append(python_parts(text))
                lines = text.split("\n")
                symbols.append([{"name": n, "kind": k, "first_line": a, "last_line": b, "code": "\n".join(lines[a - 1 : b])} for n, k, a, b in parts[-1][2]])
            yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("path"), *(pa.array([p[i] for p in parts], pa.list_(pa.string())) for i in (0, 1)), pa.array(symbols, pa.list_(_SYMBOL))], names=["repo", "path", "imports", "definitions", "symbols"])

    schema = "repo string, path string, imports array<string>, definitions array<string>, symbols array<struct<name:string,kind:string,first_line:int,last_line:int,code:string>>"
    return files.select("repo", "path", "content").mapInArrow(run, schema)


def symbol_chunks(graph: DataFrame) -> DataFrame:
    """``repo, id, path, language, node_type, name, code, start_line, end_line``: a chunk for each outermost symbol of a file.

    graph: as ``python_graph`` makes it. Symbols inside another one are part of
    its chunk; a file without symbols has none and is cut as text.
    """
    outer = F.filter("symbols", lambda s: ~F.exists("symbols", lambda o: (o["first_line"] <= s["first_line"]) & (o["last_line"] >= s["last_line"]) & ((o["first_line"] < s["first_line"]) | (o["last_line"] > s["last_line"]))))
    rows = graph.select("repo", "path", F.explode(outer).alias("s"))
    kind = F.when(F.col("s.kind") == "class", "class_definition").otherwise("function_definition")
    return rows.select("repo", F.concat("path", F.lit("::"), "s.name").alias("id"), "path", F.lit("python").alias("language"), kind.alias("node_type"), F.col("s.name").alias("name"), F.col("s.code").alias("code"), F.col("s.first_line").alias("start_line"), F.col("s.last_line").alias("end_line"))


def _folded(parts: Column) -> Column:
    """A path's segments with . and .. worked off."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _candidates(base: Column, has_ext: Column) -> Column:
    clean = F.regexp_replace(base, "/+$", "")
    more = F.array(*[F.concat(clean, F.lit(e)) for e in EXTENSIONS], *[F.concat(clean, F.lit("/index" + e)) for e in EXTENSIONS])
    return F.concat(F.array(clean), F.when(has_ext, F.array().cast("array<string>")).otherwise(more))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, file, import, target``: the file that each import means, where there is one.

    Candidates in order of preference meet the files in an equal join. What they
    miss is looked up among the endings of the files' paths: the last segment is
    a join key, with all its endings where the import is a bare name, and the
    longest path wins. imports: ``repo, file, import``; files: ``repo, path``.
    """
    slashed = lambda c: F.regexp_replace(c, r"\\", "/")
    rows = imports.select("repo", "file", "import", slashed(F.col("import")).alias("want")).distinct()
    has_ext = F.col("want").rlike(r"\.[^/.]+$")
    folder = F.split(F.regexp_replace(slashed(F.col("file")), r"[^/]*$", ""), "/")
    near = F.when(F.startswith("want", F.lit(".")), _candidates(_folded(F.concat(folder, F.split("want", "/"))), has_ext)).otherwise(F.array().cast("array<string>"))
    tried = rows.select("repo", "file", "import", F.posexplode(F.concat(near, _candidates(F.col("want"), has_ext))).alias("n", "path"))
    known = files.select("repo", slashed(F.col("path")).alias("path"), F.col("path").alias("target")).distinct()
    exact = tried.join(known, ["repo", "path"]).groupBy("repo", "file", "import").agg(F.min_by("target", "n").alias("target"))
    rest = rows.join(exact, ["repo", "file", "import"], "left_anti").withColumn("key", F.substring_index("want", "/", -1)).where("key <> ''")
    bare = F.regexp_replace("path", r"\.[^/.]+$", "")
    name = F.substring_index(bare, "/", -1)
    endings = known.withColumn("bare", bare).withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, i, 1_000_000))))
    found = rest.join(endings, ["repo", "key"]).where(F.endswith("bare", F.col("want")))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("repo", "file", "import").orderBy(F.desc(F.length("path")), "path"))).where("n = 1")
    return exact.unionByName(best.select("repo", "file", "import", "target"))


def stripped_quotes(text: Column, angles: bool = False) -> Column:
    """A literal without its quotes; angle brackets count for includes only."""
    return F.regexp_replace(text, r"""^['"`<]|['"`>]$""" if angles else r"""^['"`]|['"`]$""", "")


def outer_symbols(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """Outermost definitions of a text as name, node type, first and last line. Python goes through its parser, other languages through their tokens."""
    if language != "python":
        return [d[:4] for d in lexer.definitions(text, language) if d.parent < 0]
    out, done = [], 0
    for name, kind, first, last in sorted(python_parts(text)[2], key=lambda s: (s[2], -s[3])):
        if first > done:
            out.append((name, "class_definition" if kind == "class" else "function_definition", first, last))
            done = last
    return out


def _nested(symbols: list[tuple[str, str, int, int]]) -> list[tuple]:
    """Python's symbols by their lines, each with the number of the one that it is in."""
    out, open_ = [], []
    for name, kind, first, last in sorted(symbols, key=lambda s: (s[2], -s[3])):
        while open_ and open_[-1][1] < last:
            open_.pop()
        out.append((name, {"class": "class_definition", "method": "method_definition"}.get(kind, "function_definition"), first, last, open_[-1][0] if open_ else -1))
        open_.append((len(out) - 1, last))
    return out


def code_parts(text: str, language: str) -> tuple[list[str], list[str], list[tuple]]:
    """Imports, names of definitions, and all definitions as name, node type, first and last line and number of the one around."""
    if language == "python":
        found, names, symbols = python_parts(text)
        return found, names, _nested(symbols)
    return lexer.imports(text, language), lexer.defined_names(text, language), lexer.definitions(text, language)


_DEFINITION = pa.struct([("name", pa.string()), ("node_type", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("parent", pa.int32())])


def code_graph(files: DataFrame) -> DataFrame:
    """``repo, path, language, imports, definitions, symbols`` of every file in a language that is read.

    files: ``repo, path, content``. A symbol's ``parent`` is the place, from 0,
    of the one that it is in, or -1: methods are in their classes, in every language.
    """
    names = ["repo", "path", "language", "imports", "definitions", "symbols"]

    def run(batches):
        for batch in batches:
            parts = [code_parts(t or "", lang) for t, lang in zip(batch.column("content").to_pylist(), batch.column("language").to_pylist())]
            symbols = pa.array([[dict(zip(("name", "node_type", "first_line", "last_line", "parent"), d)) for d in p[2]] for p in parts], pa.list_(_DEFINITION))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names[:3]), *(pa.array([p[i] for p in parts], pa.list_(pa.string())) for i in (0, 1)), symbols], names=names)

    schema = "repo string, path string, language string, imports array<string>, definitions array<string>, symbols array<struct<name:string,node_type:string,first_line:int,last_line:int,parent:int>>"
    return files.select("repo", "path", language(F.col("path")).alias("language"), "content").where("language is not null").mapInArrow(run, schema)


def block_chunks(files: DataFrame) -> DataFrame:
    """``repo, id, path, language, node_type, name, code, start_line, end_line``: a chunk for each outermost definition of a file.

    files: ``repo, path, content``. Files of other languages, and those without
    definitions, have none.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for repo, path, text, lang in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content", "language"))):
                text = text or ""
                found, lines = outer_symbols(text, lang), text.split("\n")
                rows += [(repo, f"{path}::{name}", path, lang, kind, name, "\n".join(lines[a - 1 : b]), a, b) for name, kind, a, b in found]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in list(zip(*rows))[:7]), *(pa.array(c, pa.int32()) for c in list(zip(*rows))[7:])], names=names)

    names = ["repo", "id", "path", "language", "node_type", "name", "code", "start_line", "end_line"]
    schema = ", ".join(f"{n} {'int' if n.endswith('_line') else 'string'}" for n in names)
    return files.select("repo", "path", "content", language(F.col("path")).alias("language")).where("language is not null").mapInArrow(run, schema)
