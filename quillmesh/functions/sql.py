"""The functions of the package for SQL: after ``register(spark)`` they have names in ``spark.sql``.

Scalar functions are SQL functions, which the planner inlines, so they run as
the built-in expressions that they are made of. Functions that cut a text into
rows are table functions for LATERAL joins; what they are given of a scalar
function comes from a subquery.

    SELECT doc_id, c.* FROM documents, LATERAL text_chunks(text, 10000) c
    SELECT doc_id, c.* FROM (SELECT doc_id, code_tokens(text) AS k FROM documents), LATERAL term_counts(k) c
    SELECT cosine(a.v, b.v), hamming(sign_bits(a.v), sign_bits(b.v)) FROM ...
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillmesh.functions.text import BLANK
from quillmesh.functions.words import EVIDENCE_STOP, SEARCH_STOP, SUMMARY_STOP, sql_list

_IDS = "regexp_extract_all(coalesce(t, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+', 0)"
_CUT = "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> {}), {}, (s, x) -> s + x)"
_NORM = "sqrt(aggregate(slice({0}, 1, least(size(a), size(b))), 0D, (s, x) -> s + x * x))"
#: Name, parameters, type and body of each scalar function.
SCALARS = (
    ("code_tokens", "t STRING", "ARRAY<STRING>", f"filter(transform(flatten(transform({_IDS}, w -> concat(array(w), filter(split(regexp_replace(w, '([a-z0-9])([A-Z])', '$1 $2'), '[_ ]+'), p -> p <> '' AND lower(p) <> lower(w))))), x -> lower(x)), x -> length(x) >= 2 AND x NOT IN ({sql_list(SEARCH_STOP)}))"),
    ("query_symbols", "t STRING", "ARRAY<STRING>", f"array_distinct(filter(transform(regexp_extract_all(coalesce(t, ''), '[a-zA-Z_][A-Za-z0-9_]+', 0), x -> lower(x)), x -> x NOT IN ({sql_list(SEARCH_STOP)})))"),
    ("evidence_terms", "t STRING", "ARRAY<STRING>", f"slice(array_distinct(filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9][a-z0-9._/-]+', 0), x -> length(x) >= 3 AND x NOT IN ({sql_list(EVIDENCE_STOP)}))), 1, 12)"),
    ("summary_tokens", "t STRING", "ARRAY<STRING>", f"filter(split(lower(coalesce(t, '')), '[^A-Za-z0-9_]+'), x -> length(x) > 1 AND x NOT IN ({sql_list(SUMMARY_STOP)}))"),
    ("text_words", "t STRING", "ARRAY<STRING>", "transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z0-9_]+', 0), x -> lower(x))"),
    ("blank_trimmed", "t STRING", "STRING", f"btrim(t, '{BLANK.encode('unicode_escape').decode().replace(chr(92) + 'x0b', chr(92) + 'u000b').replace(chr(92) + 'x0c', chr(92) + 'u000c')}')"),
    ("dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _CUT.format("x * y", "0D")),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {_NORM.format('a')} * {_NORM.format('b')} > 0 THEN {_CUT.format('x * y', '0D')} / ({_NORM.format('a')} * {_NORM.format('b')}) ELSE 0D END"),
    ("l2_normalized", "v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "CASE WHEN aggregate(v, 0D, (s, x) -> s + x * x) > 0 THEN transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y))) ELSE v END"),
    ("sign_bits", "v ARRAY<DOUBLE>", "ARRAY<BIGINT>", "CASE WHEN size(v) > 0 THEN transform(sequence(0, CAST(ceil(size(v) / 32) AS INT) - 1), g -> aggregate(transform(slice(v, g * 32 + 1, 32), (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (s, x) -> s | x)) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
    ("hamming", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", _CUT.format("bit_count(x ^ y)", "0")),
)


def _tables() -> dict:
    """The table functions; made here, as their classes travel to the workers."""

    @udtf(returnType="code string, first_line int, last_line int")
    class TextChunks:
        def eval(self, text: str, most: int):
            from quillmesh.operators.chunking import chunk_text

            yield from chunk_text(text or "", most)

    @udtf(returnType="number int, code string")
    class TextWindows:
        def eval(self, text: str, least: int, most: int, overlap: int):
            from quillmesh.operators.chunking import window_lines

            yield from enumerate(window_lines(text or "", least, most, overlap))

    @udtf(returnType="name string, node_type string, first_line int, last_line int, parent int")
    class CodeDefinitions:
        def eval(self, text: str, language: str):
            from quillmesh.operators.extract import code_parts

            yield from (tuple(d) for d in code_parts(text or "", language or "")[2])

    @udtf(returnType="import string")
    class CodeImports:
        def eval(self, text: str, language: str):
            from quillmesh.operators.extract import code_parts

            yield from ((i,) for i in code_parts(text or "", language or "")[0])

    @udtf(returnType="term string, tf int")
    class TextTerms:
        """The search tokens of a text with their counts."""

        def eval(self, tokens: list):
            from collections import Counter

            yield from sorted(Counter(tokens or ()).items())

    return {"text_chunks": TextChunks, "text_windows": TextWindows, "code_definitions": CodeDefinitions, "code_imports": CodeImports, "term_counts": TextTerms}


def register(spark: SparkSession) -> list[str]:
    """Give a session the functions; the names that it has now."""
    for name, parameters, type_, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {type_} RETURN {body}")
    tables = _tables()
    for name, made in tables.items():
        spark.udtf.register(name, made)
    return [s[0] for s in SCALARS] + list(tables)
