"""Definitions of languages with braces, and files cut by their definitions."""

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.operators import chunking, extract, lexer, summaries

SOURCES = {
    "typescript": (
        'import x from "y";\nexport default async function load(a) {\n  const s = "}"; // }\n  return `${a} }`;\n}\nclass Foo extends Bar {\n  run() { return 1; }\n}\nexport interface P { a: string }\nconst add = (a, b) => {\n  return a + b;\n};\nconst n = 3;\n/*\nfunction hidden() {}\n*/\n',
        [("load", "function_declaration", 2, 5), ("Foo", "class_declaration", 6, 8), ("P", "interface_declaration", 9, 9), ("add", "arrow_function", 10, 12)],
    ),
    "go": (
        'package main\ntype S struct {\n  a int\n}\nfunc (s *S) Run(x int) error {\n  fmt.Println("{")\n  return nil\n}\nfunc main() { }\n',
        [("S", "type_declaration", 2, 4), ("Run", "method_declaration", 5, 8), ("main", "function_declaration", 9, 9)],
    ),
    "rust": (
        "use std::io;\npub struct P<'a> { x: &'a str }\nstruct U;\nimpl<'a> P<'a> {\n  fn get(&self) -> char { '{' }\n}\npub async fn go() -> u8 { 1 }\nimpl Display for E { fn f() {} }\n",
        [("P", "struct_item", 2, 2), ("U", "struct_item", 3, 3), ("P", "impl_item", 4, 6), ("go", "function_item", 7, 7), ("E", "impl_item", 8, 8)],
    ),
    "cpp": (
        "#include <a.h>\nstruct A { int x; };\nstatic int add(int a, int b) {\n  if (a) { return b; }\n  return a;\n}\nint decl(int a);\nvoid Foo::bar() const {\n}\n",
        [("A", "struct_specifier", 2, 2), ("add", "function_definition", 3, 6), ("Foo::bar", "function_definition", 8, 9)],
    ),
    "java": ("public class A {\n void f() { }\n}\ninterface B { }\n", [("A", "class_declaration", 1, 3), ("B", "interface_declaration", 4, 4)]),
    "python": ("def a():\n    def b():\n        pass\n\nclass C:\n    def d(self):\n        pass\n", [("a", "function_definition", 1, 3), ("C", "class_definition", 5, 7)]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_outermost_definitions(language):
    code, expected = SOURCES[language]
    assert extract.outer_symbols(code, language) == expected


@pytest.mark.parametrize("code", ["function broken() {\n", "", "x = 1", "class", "/* function a() {} */", '"function a() {}"'])
def test_nothing_is_defined(code):
    assert extract.outer_symbols(code, "javascript") == []


def test_files_are_cut_by_their_definitions(spark):
    ext = {"typescript": "ts", "go": "go", "rust": "rs", "cpp": "cpp", "java": "java", "python": "py"}
    rows = [("r", f"src/a.{ext[k]}", code) for k, (code, _) in SOURCES.items()] + [("r", "b.ts", "const n = 3;"), ("r", "c.md", "# title"), ("r", "d.ts", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    chunks = extract.block_chunks(files).collect()
    assert len(chunks) == sum(len(e) for _, e in SOURCES.values()) and {c.path for c in chunks} == {p for _, p, _ in rows[:6]}
    by = {(c.path, c.name, c.node_type): c for c in chunks}
    assert by["src/a.go", "Run", "method_declaration"].code.startswith("func (s *S) Run") and by["src/a.go", "Run", "method_declaration"].end_line == 8
    cut = chunking.chunk_files(files.select("path", "content")).collect()
    assert {c.id for c in chunks} < {c.id for c in cut} and {c.id for c in cut if c.path in ("b.ts", "c.md")} == {"b.ts::chunk_0", "c.md::chunk_0"}
    kinds = {(r.path, r.kind): r.n for r in summaries.symbol_kinds(extract.block_chunks(files)).collect()}
    assert kinds["src/a.rs", "struct"] == 2 and kinds["src/a.ts", "function"] == 2


def names(code, language):
    found = lexer.definitions(code, language)
    return [(d.name, d.node_type, found[d.parent].name if d.parent >= 0 else None) for d in found]


@pytest.mark.parametrize(
    "language, code, expected",
    [
        ("typescript", "class A<T> {\n  #n = 1;\n  static x = foo(1);\n  constructor(private a: B) { super(); }\n  async *gen<T>(a: T): Promise<void> { if (a) { call(a); } }\n  get v(): { a: 1 } | null { return null; }\n  run = () => { };\n}", [("A", "class_declaration", None), ("constructor", "method_definition", "A"), ("gen", "method_definition", "A"), ("v", "method_definition", "A")]),
        ("javascript", "const re = /function x() { [/}] \\/ }/g, y = a / b / c;\nreturn /}/.test(s);\nfunction f() { }", [("f", "function_declaration", None)]),
        ("javascript", "const t = `a ${ b ? `}${'`'}` : /* } */ {x: 1}.x } function no() {}`;\nfunction f() { function g() { } }", [("f", "function_declaration", None), ("g", "function_declaration", "f")]),
        ("typescript", "export const useIt = async (a: number, cb: () => void): Promise<string[]> => {\n};\nconst one = x => { };\nconst n = (1);\nlet later;\ntype F = (a: A) => { b: B };", [("useIt", "arrow_function", None), ("one", "arrow_function", None)]),
        ("javascript", "it('does', function () { run(function named() {}); });\nexport default class extends B { m() {} }", []),
        ("go", "package p\nimport (\n  f \"fmt\"\n  \"os\" // x\n)\ntype (\n  A struct { b struct { c int } }\n  I interface { M(x int) string }\n)\nfunc (a *A) M(x interface{}) (struct{ y int }, error) { s := `}`; return }\nfunc G[T any](x T) map[string]struct{} { }", [("A", "type_declaration", None), ("I", "type_declaration", None), ("M", "method_declaration", None), ("G", "function_declaration", None)]),
        ("rust", "/* a /* fn no() {} */ fn neither() {} */\nmod m {\n  pub(crate) unsafe extern \"C\" fn f<'a>(x: &'a str) -> char { '}' }\n}\nimpl<T: Into<String>> From<T> for P<T> where T: A { fn from(t: T) -> Self { r#\"}\"\"#; } }\nstruct U(u8);\ntrait D { fn d(&self); fn e() { } }", [("f", "function_item", None), ("P", "impl_item", None), ("from", "function_item", "P"), ("U", "struct_item", None), ("D", "trait_item", None), ("e", "function_item", "D")]),
        ("java", "@A(b = \"{\") public final class C<T> extends D implements E {\n  int x = f(1);\n  public C(int a) { super(a); }\n  @Override\n  public <R> List<R> m(T t) throws X, Y { new Runnable() { public void run() { } }; return null; }\n  abstract void n();\n  enum K { P, Q }\n  record R(int a) { }\n}", [("C", "class_declaration", None), ("C", "constructor_declaration", "C"), ("m", "method_declaration", "C"), ("K", "enum_declaration", "C"), ("R", "class_declaration", "C")]),
        ("cpp", "#define F(x) { x\nnamespace n {\ntemplate <typename T> class A : public B<T> {\n public:\n  A() : b_(1), c_{2} { }\n  ~A() { }\n  virtual int f(int a) const override { return g(a); }\n  int h();\n};\n}\nextern \"C\" { int e(void) { return 0; } }\nauto x::y(int a) -> int { const char* s = R\"q(})\" })q\"; }\nstruct S* make(void) { if (a) { return 0; } }", [("A", "class_specifier", None), ("A", "function_definition", "A"), ("~A", "function_definition", "A"), ("f", "function_definition", "A"), ("e", "function_definition", None), ("x::y", "function_definition", None), ("make", "function_definition", None)]),
    ],
)
def test_nested_definitions(language, code, expected):
    assert names(code, language) == expected


@pytest.mark.parametrize(
    "language, code, found, defined",
    [
        ("typescript", 'import a, { b as c } from "./a";\nimport "./side";\nimport type { T } from \'t\';\n// import x from "comment";\nconst s = "import y from \'string\'";\nexport { d } from "./d";\nexport * as e from `./e`;\nexport const k = require("k");\nobj.require("no");\nexport class Q {}', ["./a", "./side", "t", "./d", "./e", "k"], ["s", "k", "Q"]),
        ("go", 'package p\nimport "a"\nimport x "b/c"\nimport (\n  . "d"\n  _ "e"\n)\nfunc f() { import_ := "no" }', ["a", "b/c", "d", "e"], ["f"]),
        ("rust", "pub use std::{io,\n   fmt};\nuse a::b as c; // use no;\nfn f() { use inner::x; }", ["std::{io, fmt}", "a::b as c", "inner::x"], ["f"]),
        ("c", '#include <stdio.h>\n# include "a/b.h"\n// #include "no.h"\n/*\n#include "no2.h"\n*/\nint main(void) { return 0; }', ["stdio.h", "a/b.h"], ["main"]),
        ("java", "import a.b; class C {}", [], ["C"]),
    ],
)
def test_imports_are_tokens(language, code, found, defined):
    assert lexer.imports(code, language) == found and lexer.defined_names(code, language) == defined


_PIECES = ["{", "}", "(", ")", "[", "]", "<", ">", ";", ",", ":", "::", "=", "=>", "`", "${", '"', "'", "/", "*", "/*", "*/", "//", "\n", "#", "\\", 'r#"', 'R"x(', "class A", "function f", "fn g", "func (a) h", "type T struct", "impl", "for", "const c =", "async", "struct S", "interface I", "name", "1.5", "é", "import", "from", "'a"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=60), st.sampled_from(sorted(lexer.FAMILY)))
def test_any_text_has_nested_definitions(pieces, language):
    code = " ".join(pieces)
    cut = lexer.tokens(code, lexer.FAMILY[language])
    assert all(a.end <= b.start for a, b in zip(cut, cut[1:])) and all(code[t.start : t.end] == t.text and t.text for t in cut)
    found = lexer.definitions(code, language)
    for i, d in enumerate(found):
        assert d.first_line <= d.last_line and d.parent < i
        if d.parent >= 0:
            assert found[d.parent].first_line <= d.first_line and d.last_line <= found[d.parent].last_line
    lexer.imports(code, language), lexer.defined_names(code, language)


@pytest.mark.parametrize("language", sorted(lexer.FAMILY))
def test_long_texts_take_time_in_proportion(language):
    import time

    for piece in ("function a() {\n", "class A { m() { ", "fn a() { ", "func a() { ", "`${`", "/* ", "( [ { ", "a < b, ", "type T struct { ", "int f(int a) { ", "const a = (b) : ", "} ) ] "):
        took = []
        for n in (2000, 16000):
            began = time.perf_counter()
            lexer.definitions(piece * n, language)
            took.append(time.perf_counter() - began)
        assert took[1] < 3 + 40 * took[0], (piece, took)


def test_graph_of_files_in_all_languages(spark):
    ext = {"typescript": "ts", "go": "go", "rust": "rs", "cpp": "cpp", "java": "java", "python": "py"}
    rows = [("r", f"src/a.{ext[k]}", code) for k, (code, _) in SOURCES.items()] + [("r", "b.ts", None), ("r", "c.md", "# t")]
    got = {r.path: r for r in extract.code_graph(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert set(got) == {p for _, p, _ in rows} - {"c.md"} and got["b.ts"].symbols == [] and got["src/a.ts"].imports == ["y"]
    for path, outer, inner in (("src/a.ts", "Foo", ("run", "method_definition")), ("src/a.java", "A", ("f", "method_declaration")), ("src/a.py", "C", ("d", "method_definition"))):
        symbols = got[path].symbols
        assert [(s.name, s.node_type) for s in symbols if s.parent >= 0 and symbols[s.parent].name == outer] == [inner]
