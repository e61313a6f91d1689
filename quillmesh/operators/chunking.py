"""Cutting files into chunks, and samples of what is too large to cut.

Packing paragraphs into chunks is a fold over one file, so it runs as a small
function over Arrow batches; everything else is columns.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import BLANK
from quillmesh.operators.extract import outer_symbols
from quillmesh.operators.paths import extension, language

#: Limits, in characters: a file, a chunk of text, a sampled field, all samples; how many samples, and their seed.
FILE_CHARS, TEXT_CHARS, CHUNK_CHARS, FIELD_CHARS, SAMPLES_CHARS, SAMPLE_COUNT, SEED = 120_000, 2_048, 20_000, 200, 8_000, 20, 42
#: Extensions of data files, and what starts a part of a source file.
DATA_EXTENSIONS = ("json", "bin", "pt", "onnx", "ckpt", "npy", "npz", "parquet", "csv")
_PARAGRAPH = re.compile(r"\n\n+")
# Judged by its own line and by ASCII, as in the SQL of text_chunks: \s is without \v there, and only a blank at the end may be the line's end.
_BOUNDARY = re.compile(r"\n(?=(?:export|function|class|interface|type|def|##?)[ \t\n\r\f]|async[ \t\r\f]+function|const[ \t\r\f]+[A-Za-z0-9_]+[ \t\r\f]*=)")


def _pieces(text: str, start: int, end: int, pattern: re.Pattern):
    """Spans between the matches of a pattern."""
    at = start
    for m in pattern.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def _units(text: str, most: int):
    """Spans of paragraphs; a long one in parts that begin at a boundary, and what has no boundary in equal lengths."""
    for start, end in _pieces(text, 0, len(text), _PARAGRAPH):
        if end - start <= most:
            yield start, end
            continue
        held = None
        for a, b in _pieces(text, start, end, _BOUNDARY):
            if a == b:
                continue
            if held and b - held[0] <= most:
                held = (held[0], b)
                continue
            if held:
                yield held
                held = None
            if b - a <= most:
                held = (a, b)
            else:
                yield from ((i, min(i + most, b)) for i in range(a, b, most))
        if held:
            yield held


def chunk_text(text: str, most: int = TEXT_CHARS) -> list[tuple[str, int, int]]:
    """``code, first line, last line`` of each chunk: units in a row, as they stand in the text, up to ``most`` characters."""
    spans, held = [], None
    for a, b in _units(text, most):
        if held and held[1] > held[0] and (held[1] - held[0]) + (b - a) > most:
            spans.append(held)
            held = None
        held = (held[0], b) if held else (a, b)
    if held:
        spans.append(held)
    out, line, at = [], 1, 0
    for a, b in spans:
        code = text[a:b]
        bare = code.strip(BLANK)
        if not bare:
            continue
        first = a + len(code) - len(code.lstrip(BLANK))
        line += text.count("\n", at, first)
        at = first
        out.append((bare, line, line + bare.count("\n")))
    return out


def random_indices(length: int, count: int = SAMPLE_COUNT, seed: int = SEED) -> list[int]:
    """Distinct places from a linear congruential generator, in order. Its constants."""
    seen, state = set(), seed
    while len(seen) < min(length, count):
        state = (1664525 * state + 1013904223) % 2**32
        seen.add(state % length)
    return sorted(seen)


def clipped(text: Column) -> Column:
    return F.when(F.length(text) > FIELD_CHARS, F.concat(F.substring(text, 1, FIELD_CHARS), F.lit("...(truncated)"))).otherwise(text)


def samples(items: Column, count: int = SAMPLE_COUNT) -> dict[str, Column]:
    """The first, the last and the middle items of an array."""
    n = F.least(F.size(items), F.lit(count))
    middle = F.floor((F.size(items) - n) / 2).cast("int")
    return {"head": F.slice(items, 1, n), "tail": F.slice(items, F.size(items) - n + 1, n), "middle": F.slice(items, middle + 1, n)}


def _clip(value):
    if isinstance(value, str):
        return value if len(value) <= FIELD_CHARS else value[:FIELD_CHARS] + "...(truncated)"
    if isinstance(value, list):
        return [_clip(v) for v in value[:8]]
    if isinstance(value, dict):
        return {k: _clip(v) for k, v in list(value.items())[:8]}
    return value


def _places(n: int) -> dict[str, list[int]]:
    k = min(n, SAMPLE_COUNT)
    middle = (n - k) // 2
    return {"head": list(range(k)), "tail": list(range(n - k, n)), "middle": list(range(middle, middle + k)), "random": random_indices(n) if n else []}


def summarise(path: str, text: str, lang: str | None) -> tuple[str, int]:
    """A summary that stands for a file too large to cut, and the file's number of lines."""
    lines = text.split("\n")
    known, inferred, unknown, evidence = [f"path: {path}", f"size_chars: {len(text)}", f"line_count: {len(lines)}"], [], [], []
    payload = {k: [{"line": i + 1, "text": _clip(lines[i])} for i in at] for k, at in _places(len(lines)).items()}
    if path.lower().endswith(".json"):
        try:
            value = json.loads(text)
            kind = {list: "array", dict: "object", str: "string", bool: "boolean"}.get(type(value), "number" if value is not None else "object")
            known.append(f"json_root_type: {kind}")
            evidence.append("json.parse(content) succeeded")
            if isinstance(value, dict):
                known += [f"top_level_key_count: {len(value)}", f"top_level_keys_sample: {json.dumps(list(value)[:SAMPLE_COUNT], separators=(',', ':'))}"]
                rows = list(value.items())
                payload = {k: [{"key": rows[i][0], "value": _clip(rows[i][1])} for i in at] for k, at in _places(len(rows)).items()}
            elif isinstance(value, list):
                known.append(f"array_length: {len(value)}")
                payload = {k: [{"index": i, "value": _clip(value[i])} for i in at] for k, at in _places(len(value)).items()}
            else:
                payload = dict.fromkeys(("head", "tail", "middle", "random"), _clip(value))
        except ValueError:
            inferred.append("content looks like JSON but full parse failed")
            unknown.append("exact JSON structure (parse failed on omitted payload)")
            evidence.append("json.parse(content) failed")
    else:
        unknown.append("full file semantics are not fully known because only bounded samples were kept")
        evidence.append("head/tail/middle/random text sampling")
    shown = json.dumps(payload, indent=2, ensure_ascii=False)
    shown = shown if len(shown) <= SAMPLES_CHARS else shown[:SAMPLES_CHARS] + "\n...(truncated)"
    bullets = lambda rows: [f"- {r}" for r in rows]
    # fixed values: the lines of this summary are output text that has to match
    parts = [
        "[LARGE_FILE_SUMMARY]", f"path: {path}", f"language: {lang or 'text'}", "reason: exceeded chunking guardrails; full payload omitted", "", "known:", *bullets(known), "", "inferred:", *bullets(inferred or ["none"]),
        "", "unknown:", *bullets(unknown), "", "evidence:", *bullets(evidence), "", "samples:", shown, "", "confidence: medium",
    ]
    return "\n".join(parts)[:CHUNK_CHARS], len(lines)


CHUNK_SCHEMA = "id string, path string, language string, node_type string, name string, code string, start_line int, end_line int"
_ARROW = pa.schema([*((n, pa.string()) for n in ("id", "path", "language", "node_type", "name", "code")), ("start_line", pa.int32()), ("end_line", pa.int32())])


def _chunked(batches):
    for batch in batches:
        rows = []
        for path, text, lang, large in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "language", "large"))):
            if large:
                code, lines = summarise(path, text, lang)
                rows.append((f"{path}::large_file_summary", path, lang or "text", "file_summary", "large_file_summary", code, 1, lines))
            elif symbols := outer_symbols(text, lang):
                lines = text.split("\n")
                rows += [(f"{path}::{name}", path, lang, kind, name, "\n".join(lines[a - 1 : b]), a, b) for name, kind, a, b in symbols]
            else:
                rows += [(f"{path}::chunk_{i}", path, lang or "text", "text_chunk", f"chunk_{i}", *c) for i, c in enumerate(chunk_text(text))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of every file ``path, content``: its outermost definitions, or cut text where it has none, or one summary of a file that is too large.

    A null content has no chunks. Lines are those of the file.
    """
    ext = extension(F.col("path"))
    large = (F.length("content") > FILE_CHARS) | (ext.isin(*DATA_EXTENSIONS) & (F.length("content") > TEXT_CHARS))
    rows = files.where("content is not null").select("path", "content", language(F.col("path")).alias("language"), large.alias("large"))
    return rows.mapInArrow(_chunked, CHUNK_SCHEMA)


def window_lines(text: str, least: int = 500, most: int = 700, overlap: int = 60) -> list[str]:
    """Windows of whole lines: cut once ``least`` characters are there, at most ``most`` of them, each beginning with the end of the one before."""
    out, held = [], ""
    for line in text.split("\n"):
        held += line + "\n"
        while len(held) > most:  # a long line fills windows of its own
            out.append(held[:most])
            held = held[most - overlap :]
        if len(held) >= least:
            out.append(held)
            held = held[-overlap:]
    if held.strip():
        out.append(held[:most])
    return out


