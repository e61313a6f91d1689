"""Definitions and imports of source files out of their tokens, without a grammar.

A text is cut into words, strings and punctuation, with the state that this
takes: template literals hold code that holds templates, a slash begins a
regular expression or divides, raw strings end where they say, and Rust's
comments nest. Brackets are matched in one pass. A definition is a pattern of
tokens whose body is a matched bracket, so what looks like one inside a comment
or a string isn't, an unclosed one is none, and each knows which one it is in.
All passes are linear in the text.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

#: Languages by the family whose tokens they share.
FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "go": "go", "rust": "rust", "java": "java", "c": "c", "cpp": "c"}
_WORD, _NUMBER = r"(?P<w>[A-Za-z_$\u0080-\U0010ffff][\w$]*)", r"(?P<n>\d[\w.]*)"
_SPACE, _DOUBLE, _SINGLE = r"\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?"
_STRINGS = {
    "js": f"{_DOUBLE}|{_SINGLE}",
    "go": f"`[^`]*`?|{_DOUBLE}|{_SINGLE}",
    "rust": r"""b?r(?P<hash>#*)"[\s\S]*?(?:"(?P=hash)|\Z)|b?"(?:\\[\s\S]|[^"\\])*"?|b?'(?:\\(?:u\{[^}\n]*\}|x..|.)|[^'\\\n])'""",
    "java": rf'"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE}',
    "c": rf'(?:u8|[uUL])?R"(?P<mark>[^()\\\s"]{{0,16}})\([\s\S]*?(?:\)(?P=mark)"|\Z)|(?:u8|[uUL])?{_DOUBLE}|(?:u8|[uUL])?{_SINGLE}',
}
_SKIPPED = {"rust": r"\s+|//[^\n]*|'[A-Za-z_]\w*(?!')", "c": _SPACE}
_INCLUDE = r'(?P<i>\#[ \t]*include[ \t]*(?:<[^>\n]+>|"[^"\n]+"))|\#(?:\\\r?\n|[^\n])*|'
_TOKEN = {f: re.compile(rf"(?:{_SKIPPED.get(f, _SPACE)})|{_INCLUDE if f == 'c' else ''}(?P<s>{s})|{_WORD}|{_NUMBER}|(?P<p>=>|->|::|\.\.\.|[\s\S])") for f, s in _STRINGS.items()}
_QUOTED = re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_DOUBLE}|{_SINGLE}")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_NESTED = re.compile(r"/\*|\*/")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Words that no definition is named by.
_RESERVED = frozenset("if for while switch return else do catch try new delete throw sizeof typeof await yield case default super this synchronized using namespace function class operator".split())
_MODIFIERS = {
    "js": frozenset("export default async abstract declare const public private protected static readonly override get set accessor".split()),
    "go": frozenset(),
    "rust": frozenset("pub const async unsafe extern default crate".split()),
    "java": frozenset("public protected private abstract final static sealed strictfp default native synchronized".split()),
    "c": frozenset("static inline extern constexpr virtual typedef explicit friend const volatile".split()),
}


class Token(NamedTuple):
    """``kind``: word, number, string, include or punctuation."""

    kind: str
    text: str
    start: int
    end: int


class Definition(NamedTuple):
    """``parent``: the number of the definition that holds it, or -1."""

    name: str
    node_type: str
    first_line: int
    last_line: int
    parent: int


def _template_end(code: str, at: int) -> int:
    """Where the template literal that begins at ``at`` ends, with what its placeholders hold."""
    inside, at = ["`"], at + 1
    while at < len(code) and inside:
        c = code[at]
        if inside[-1] == "`":
            if c == "\\":
                at += 1
            elif c == "`":
                inside.pop()
            elif code.startswith("${", at):
                inside.append("{")
                at += 1
        elif (m := _QUOTED.match(code, at)) and c in "\"'/":
            at = m.end() - 1
        elif c in "`{":
            inside.append(c)
        elif c == "}":
            inside.pop()
        at += 1
    return min(at, len(code))


def _comment_end(code: str, at: int) -> int:
    """Where the nested comment that begins at ``at`` ends."""
    depth = 0
    for m in _NESTED.finditer(code, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(code)


def tokens(code: str, family: str) -> list[Token]:
    """Words, numbers, strings and punctuation of a text; a template or a regular expression is one string."""
    out: list[Token] = []
    at, match = 0, _TOKEN[family].match
    while at < len(code):
        if family == "rust" and code.startswith("/*", at):
            at = _comment_end(code, at)
            continue
        m = match(code, at)
        kind, end = m.lastgroup, m.end()
        if kind in ("hash", "mark"):
            kind = "s"
        if kind == "p" and family == "js" and code[at] in "`/":
            if code[at] == "`":
                kind, end = "s", _template_end(code, at)
            else:
                last = out[-1] if out else None
                operand = last and (last.kind in "ns" or last.text in ")]}" or last.kind == "w" and last.text not in _BEFORE_REGEX)
                if not operand and (r := _REGEX.match(code, at)):
                    kind, end = "s", r.end()
        if kind:
            out.append(Token(kind, code[at:end], at, end))
        at = end
    return out


class _Source:
    """Tokens of a text with their matching brackets: ``closed[i]`` is where bracket i closes, ``within[i]`` the open brace that holds token i."""

    def __init__(self, code: str, language: str):
        self.code, self.family = code, FAMILY[language]
        self.t = tokens(code, self.family)
        self.closed: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        self.within: list[int] = []
        self.lines = [m.start() for m in re.finditer("\n", code)]
        stack: list[int] = []
        braces, open_ = [-1], {"(": 0, "[": 0, "{": 0}
        for i, t in enumerate(self.t):
            if t.kind == "p" and t.text in _CLOSES and open_[_CLOSES[t.text]]:
                while stack:  # what isn't closed by its own kind isn't closed
                    j = stack.pop()
                    open_[self.t[j].text] -= 1
                    if self.t[j].text == "{":
                        braces.pop()
                    if self.t[j].text == _CLOSES[t.text]:
                        self.closed[j], self.opened[i] = i, j
                        break
            self.within.append(braces[-1])
            if t.kind == "p" and t.text in open_:
                stack.append(i)
                open_[t.text] += 1
                if t.text == "{":
                    braces.append(i)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "w"

    def line(self, i: int, end: bool = False) -> int:
        return bisect.bisect_left(self.lines, self.t[i].end - 1 if end else self.t[i].start) + 1

    def over(self, i: int, opens: str, closes: str) -> int:
        """Behind angle brackets that open at ``i``; ``i`` if none do or they don't close."""
        if self.text(i) != opens:
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.text(j)
            depth += (x == opens) - (x == closes)
            if depth == 0:
                return j + 1
            if x in "{};":
                return i
            j = self.closed.get(j, j) + 1
        return i

    def body(self, i: int, skip: frozenset = frozenset(), until: str = ";") -> int | None:
        """The closed brace that begins at ``i`` or behind, before a closing bracket or ``until``."""
        while i < len(self.t):
            x = self.text(i)
            if x == "{":
                if self.text(i - 1) not in skip:
                    return i if i in self.closed else None
            elif x in until or x in ")]}":
                return None
            i = self.closed.get(i, i) + 1
        return None

    def ended(self, i: int) -> int | None:
        """The semicolon at or behind ``i`` on the same level."""
        while i < len(self.t):
            if self.text(i) == ";":
                return i
            if self.text(i) in ("}", ")", "]"):
                return None
            i = self.closed.get(i, i) + 1
        return None

    def begun(self, i: int) -> int:
        """The first of the modifiers before ``i``."""
        while i > 0:
            if self.text(i - 1) in _MODIFIERS[self.family]:
                i -= 1
            elif self.family == "rust" and self.text(i - 1) == ")" and (j := next((k for k in range(i - 2, max(-1, i - 8), -1) if self.text(k) == "("), None)) and self.text(j - 1) == "pub":
                i = j - 1
            elif self.family == "rust" and self.t[i - 1].kind == "s" and self.text(i - 2) == "extern":
                i -= 2
            else:
                break
        return i


def _js(s: _Source, i: int, classes: set[int]):
    x, t = s.text(i), s.text
    if x == "function" and t(s.begun(i) - 1) not in ("=", "(", ",", "=>", ":", "return", "?", "&", "|"):
        at = i + 1 + (t(i + 1) == "*")
        if s.word(at) and (b := s.body(at + 1)) is not None:
            return t(at), "function_declaration", s.begun(i), s.closed[b]
    if x in ("class", "interface", "enum") and s.word(i + 1) and t(i + 1) not in ("extends", "implements") and t(i - 1) != "." and (b := s.body(i + 2)) is not None:
        if x == "class":
            classes.add(b)
        return t(i + 1), f"{x}_declaration", s.begun(i), s.closed[b]
    if x in ("const", "let", "var") and s.word(i + 1) and t(i + 1) not in ("enum", "function"):
        j = i + 2
        while j < len(s.t) and t(j) not in ("=", ";", ",", "{", "}", ")") and not s.word(j) or t(j) in ("=>",) or (j > i + 2 and s.word(j)):
            j = s.closed.get(j, j) + 1
        if t(j) == "=":
            j += 1 + (t(j + 1) == "async")
            j = s.over(j, "<", ">")
            after = s.closed.get(j, j) + 1 if t(j) == "(" else j + 1
            if t(j) == "(" and t(after) == ":":  # a type of what comes back
                while after < len(s.t) and t(after) not in ("=>", ";", "="):
                    after = s.closed.get(after, after) + 1
            if (t(j) == "(" or s.word(j)) and t(after) == "=>" and t(after + 1) == "{" and after + 1 in s.closed:
                return t(i + 1), "arrow_function", s.begun(i), s.closed[after + 1]
    if s.within[i] in classes and s.word(i) and x not in _RESERVED:
        j = s.over(i + 1, "<", ">")
        if t(j) == "(" and j in s.closed and (t(i - 1) in ("{", "}", ";", ")", "*", "#") or t(i - 1) in _MODIFIERS["js"]) and (b := s.body(s.closed[j] + 1, frozenset((":", "|", "&")), ";=")) is not None:
            return x, "method_definition", s.begun(i), s.closed[b]
    return None


def _go(s: _Source, i: int, classes: set[int]):
    x, t = s.text(i), s.text
    skip = frozenset(("interface", "struct"))
    if x == "func" and s.within[i] == -1:
        at, kind = i + 1, "function_declaration"
        if t(at) == "(" and at in s.closed:
            at, kind = s.closed[at] + 1, "method_declaration"
        if s.word(at) and (b := s.body(at + 1, skip)) is not None:
            return t(at), kind, i, s.closed[b]
    if x in ("struct", "interface") and t(i + 1) == "{" and i + 1 in s.closed:
        name = i - 1
        if t(name) == "]":  # type parameters
            while name > 0 and t(name) != "[":
                name -= 1
            name -= 1
        if t(name) == "=":
            name -= 1
        if s.word(name) and (t(name - 1) == "type" or t(name - 1) in ("(", "}") or s.word(name - 1)) and _typed(s, name):
            return t(name), "type_declaration", name - 1 if t(name - 1) == "type" else name, s.closed[i + 1]
    return None


def _typed(s: _Source, name: int) -> bool:
    """Whether the name of a Go type stands behind ``type`` or in a group of types."""
    if s.text(name - 1) == "type":
        return True
    at = name - 1
    while at >= 0 and s.within[at] == s.within[name] and s.text(at) not in ("func", "var", "const", "import"):
        if s.text(at) == "(":
            return s.text(at - 1) == "type"
        at = s.opened.get(at, at) - 1
    return False


def _rust(s: _Source, i: int, classes: set[int]):
    x, t = s.text(i), s.text
    if x in ("fn", "struct", "enum", "trait", "union") and s.word(i + 1) and t(i - 1) not in (".", "::"):
        kind = {"fn": "function_item"}.get(x, f"{x}_item")
        end = s.body(i + 2)
        if end is not None:
            return t(i + 1), kind, s.begun(i), s.closed[end]
        if x == "struct" and (end := s.ended(i + 2)) is not None:
            return t(i + 1), kind, s.begun(i), end
    if x == "impl" and t(i - 1) in ("", "}", ";", "{", "]", "unsafe"):
        at, b = s.over(i + 1, "<", ">"), s.body(i + 1)
        if b is not None:
            depth, names = 0, []
            for j in range(at, b):
                depth += (t(j) == "<") - (t(j) == ">")
                if t(j) == "where" and not depth:
                    break
                if t(j) == "for" and not depth:
                    names = []
                elif s.word(j) and not depth and t(j) not in ("dyn", "mut", "const"):
                    names.append(t(j))
            if names:
                return names[-1], "impl_item", s.begun(i), s.closed[b]
    return None


def _java(s: _Source, i: int, classes: set[int]):
    x, t = s.text(i), s.text
    if x in ("class", "interface", "enum", "record") and s.word(i + 1) and t(i - 1) != "." and (x != "record" or t(s.over(i + 2, "<", ">")) == "("):
        b = s.body(i + 2)
        if b is not None:
            classes.add(b)
            return t(i + 1), {"record": "class_declaration"}.get(x, f"{x}_declaration"), s.begun(i), s.closed[b]
    if s.within[i] in classes and s.word(i) and x not in _RESERVED and t(i + 1) == "(" and i + 1 in s.closed and t(i - 1) not in (".", "=", "new", "(", ",", "@", "return", "record"):
        b = s.body(s.closed[i + 1] + 1, until=";=")
        if b is not None and all(s.word(k) or t(k) in (",", ".", "<", ">", "@", "[", "]") for k in range(s.closed[i + 1] + 1, b)):
            typed = s.word(i - 1) and t(i - 1) not in _MODIFIERS["java"] or t(i - 1) in (">", "]")
            first = i
            while typed and first > 0 and (s.word(first - 1) or t(first - 1) in ("<", ">", "[", "]", ".", ",", "?")) and t(first - 1) not in _RESERVED:
                first -= 1
            return x, "method_declaration" if typed else "constructor_declaration", s.begun(first), s.closed[b]
    return None


def _c(s: _Source, i: int, classes: set[int]):
    x, t = s.text(i), s.text
    if x in ("class", "struct") and s.word(i + 1) and t(i - 1) not in ("enum", "<", ","):
        j = i + 2
        while j < len(s.t) and (s.word(j) or t(j) in (":", "::", ",", "<", ">")):
            j += 1
        if t(j) == "{" and j in s.closed:
            classes.add(j)
            first = s.begun(i)
            if t(first - 1) == ">":  # template<...>
                k = next((k for k in range(first - 2, -1, -1) if t(k) == "template"), None)
                first = k if k is not None and s.over(k + 1, "<", ">") == first else first
            return t(i + 1), f"{x}_specifier", first, s.closed[j]
    if s.word(i) and x not in _RESERVED and t(i + 1) == "(" and i + 1 in s.closed:
        held = s.within[i]
        if held not in (-1, *classes) and not (held >= 0 and (t(held - 2) == "namespace" or t(held - 1) == "namespace" or s.t[held - 1].kind == "s")):
            return None
        j = s.closed[i + 1] + 1
        while s.word(j) and t(j) in ("const", "noexcept", "override", "final", "volatile", "try") or t(j) == "&":
            j += 1
        if t(j) == "->":
            while j < len(s.t) and t(j) not in ("{", ";", "}"):
                j = s.closed.get(j, j) + 1
        if t(j) == ":":  # members that are set before the body
            j += 1
            while s.word(j):
                j += 1
                while t(j) == "::" or s.word(j):
                    j += 1
                j = s.closed.get(j, j) + 1
                j += t(j) == ","
        if t(j) == "{" and j in s.closed:
            name, at = x, i - 1
            if t(at) == "~":
                name, at = f"~{name}", at - 1
            while t(at) == "::" and s.word(at - 1):
                name, at = f"{t(at - 1)}::{name}", at - 2
            if s.word(at) and t(at) not in _RESERVED or t(at) in ("*", "&", ">") or held in classes or name.count("::"):
                first = at + 1
                while first > 0 and s.within[first - 1] == held and (s.word(first - 1) and t(first - 1) not in _RESERVED and t(first - 2) != "#" or t(first - 1) in ("*", "&", "<", ">", "::", ",")) and first - 1 not in s.closed:
                    first -= 1
                return name, "function_definition", first, s.closed[j]
    return None


_FINDERS = {"js": _js, "go": _go, "rust": _rust, "java": _java, "c": _c}


def _found(s: _Source) -> list[tuple[str, str, int, int]]:
    """Name, node type, first and last token of every definition, those that hold others first."""
    classes: set[int] = set()
    finder = _FINDERS[s.family]
    return sorted((d for i in range(len(s.t)) if s.t[i].kind == "w" and (d := finder(s, i, classes))), key=lambda d: (d[2], -d[3]))


def definitions(code: str, language: str) -> list[Definition]:
    """The definitions of a text in order, each with the one that it is in."""
    if language not in FAMILY:
        return []
    s = _Source(code, language)
    out, open_ = [], []
    for name, kind, first, last in _found(s):
        while open_ and open_[-1][1] < last:
            open_.pop()
        out.append(Definition(name, kind, s.line(first), s.line(last, True), open_[-1][0] if open_ else -1))
        open_.append((len(out) - 1, last))
    return out


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "\"'`<" else text


def imports(code: str, language: str) -> list[str]:
    """What a text imports, in order, once each; only tokens count, so comments and strings import nothing."""
    if language not in FAMILY:
        return []
    s = _Source(code, language)
    t, out = s.text, []
    for i, x in enumerate(s.t):
        string = lambda j: 0 <= j < len(s.t) and s.t[j].kind == "s" and s.t[j].text[0] in "\"'`"
        if s.family == "js" and x.kind == "w" and t(i - 1) != ".":
            if x.text == "require" and t(i + 1) == "(" and string(i + 2):
                out.append(_unquoted(t(i + 2)))
            elif x.text in ("import", "export"):
                j = i + 1
                if x.text == "import" and string(j):
                    out.append(_unquoted(t(j)))
                    continue
                while j < len(s.t) and (s.word(j) and t(j) != "from" or t(j) in ("*", ",", "{")) and t(j) not in ("function", "class", "const", "let", "var", "default", "interface", "enum"):
                    j = s.closed.get(j, j) + 1
                if t(j) == "from" and string(j + 1):
                    out.append(_unquoted(t(j + 1)))
        elif s.family == "go" and x.text == "import" and s.within[i] == -1:
            last = s.closed.get(i + 1, i + 3) if t(i + 1) == "(" else i + 3
            out += [_unquoted(t(j)) for j in range(i + 1, min(last, len(s.t))) if string(j)][: None if t(i + 1) == "(" else 1]
        elif s.family == "rust" and x.kind == "w" and x.text == "use" and t(i - 1) in ("", ";", "}", "{", "]", "pub", ")") and (end := s.ended(i + 1)) is not None:
            out.append(" ".join(code[s.t[i + 1].start : s.t[end].start].split()))
        elif x.kind == "i":
            out.append(re.search(r'[<"]([^>"]+)', x.text)[1])
    return list(dict.fromkeys(out))


def defined_names(code: str, language: str) -> list[str]:
    """Names of the definitions of a text, and in JavaScript of what it declares at any depth, once each."""
    if language not in FAMILY:
        return []
    s = _Source(code, language)
    named = [(first, name) for name, kind, first, _ in _found(s) if kind not in ("impl_item", "method_definition", "method_declaration", "constructor_declaration") or s.family == "go"]
    if s.family == "js":
        named += [(i, s.text(i + 1)) for i, x in enumerate(s.t) if x.kind == "w" and x.text in ("const", "let", "var") and s.word(i + 1) and s.text(i + 2) in ("=", ":")]
    return list(dict.fromkeys(name for _, name in sorted(named)))
