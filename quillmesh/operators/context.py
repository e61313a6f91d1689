"""Contexts within a budget: results as they are, or files, directories and at last all of them compacted.

Every level is a grouping of a query's results, which a search bounds; all
queries go through together, and each takes the first level that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.paths import directory

_HOSTED = {"max_chars": 300_000, "max_tokens": 75_000, "file_chars": 60_000, "dir_chars": 120_000, "dir_files": 12, "snippet": 2_000}
#: Limits of hosted models and of local ones.
LIMITS = {"gemini": _HOSTED, "groq": _HOSTED, "mlc": {"max_chars": 24_000, "max_tokens": 6_000, "file_chars": 8_000, "dir_chars": 12_000, "dir_files": 6, "snippet": 1_200}}
TOP_FILES, TOP_BLOCKS, SAMPLED = 8, 12, 4


def _lines(*parts) -> Column:
    """Lines of text; strings and columns of strings or of arrays of them."""
    cols = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.concat(*cols), "\n")


def _one(*parts) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _ordered(cols: list[str], top: int | None = None) -> Column:
    """A query's blocks by score, equal ones as they come."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", *cols)))
    return F.slice(rows, 1, top) if top else rows


def _rendered(blocks: DataFrame, name: str) -> DataFrame:
    text = F.concat(F.lit("### "), "file", F.lit(" ("), "node_type", F.lit(", score: "), F.format_string("%.3f", "score"), F.lit(")\n```\n"), "code", F.lit("\n```"))
    rows = blocks.withColumn("text", text).groupBy("query_id").agg(_ordered(["text"]).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias(name), F.size("b").alias(f"{name}_n"))


def _files(blocks: DataFrame, limits: dict) -> DataFrame:
    by = Window.partitionBy("query_id", "file")
    rows = blocks.withColumns({"total": F.sum(F.length("code")).over(by), "n": F.count("*").over(by), "place": F.row_number().over(by.orderBy(F.desc("score"), "ord"))})
    sample = F.substring("code", 1, limits["snippet"])
    # fixed values: the lines of this summary and of the two below are output text that has to match
    code = _lines(
        "[FILE_COMPACTION_SUMMARY]", _one("file: ", F.col("file")), "", "known:", _one("- chunk_count_in_context: ", F.col("n")), _one("- total_chars_in_context: ", F.col("total")), "", "inferred:",
        "- file may contain broad or verbose content; summarized to stay in budget", "", "unknown:", "- omitted file sections not shown in this compact view", "", "evidence:", _one("- retained_top_snippet_chars: ", F.length(sample)),
        "", "snippet:", F.array(sample), "", "confidence: medium",
    )
    over = F.col("total") > limits["file_chars"]
    kept = rows.where(~over | (F.col("place") == 1))
    return kept.select("query_id", "file", "dir", "score", "ord", F.when(over, "file_compaction_summary").otherwise(F.col("node_type")).alias("node_type"), F.when(over, code).otherwise(F.col("code")).alias("code"))


def _directories(blocks: DataFrame, limits: dict, strict_compat: bool) -> DataFrame:
    shown = F.min("score") if strict_compat else F.max("score")
    by_file = blocks.groupBy("query_id", "dir", "file").agg(F.max("score").alias("best"), shown.alias("shown"), F.sum(F.length("code")).alias("chars"), F.min("ord").alias("ord"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("s"), "ord", "file", "shown"))), 1, TOP_FILES)
    dirs = by_file.groupBy("query_id", "dir").agg(F.count("*").alias("n"), F.sum("chars").alias("total"), top.alias("top")).where((F.col("n") > limits["dir_files"]) | (F.col("total") > limits["dir_chars"]))
    code = _lines(
        "[DIRECTORY_COMPACTION_SUMMARY]", _one("directory: ", F.col("dir")), "", "known:", _one("- file_count_in_context: ", F.col("n")), _one("- total_chars_in_context: ", F.col("total")),
        _one("- overflow_reason: ", F.when(F.col("n") > limits["dir_files"], "too many files in context").otherwise("too many chars in context")), "", "inferred:",
        "- directory likely contains broad related context; compacted for token budget", "", "unknown:", "- non-listed files or omitted sections may contain additional details", "", "evidence:",
        "- top_files_by_retrieval_score in current context", "", "top_files:", F.transform("top", lambda x: F.concat(F.lit("- "), x["file"], F.lit(" ("), F.format_string("%.3f", x["shown"]), F.lit(")"))), "", "confidence: medium",
    )
    compact = dirs.select("query_id", F.concat("dir", F.lit("/[context_directory_summary]")).alias("file"), "dir", F.col("top")[0]["shown"].alias("score"), F.col("top")[0]["ord"].alias("ord"), F.lit("directory_compaction_summary").alias("node_type"), code.alias("code"))
    rest = blocks.join(dirs.select("query_id", "dir"), ["query_id", "dir"], "left_anti").select(compact.columns)
    return rest.unionByName(compact)


def _repository(blocks: DataFrame, limits: dict) -> DataFrame:
    rows = blocks.groupBy("query_id").agg(F.count("*").alias("n"), _ordered(["file", "code"], TOP_BLOCKS).alias("top"))
    sample = F.array_join(F.transform(F.slice("top", 1, SAMPLED), lambda x: F.concat(x["file"], F.lit(": "), F.substring(x["code"], 1, limits["snippet"] // 2))), "\n\n")
    code = _lines(
        "[REPO_COMPACTION_SUMMARY]", "", "known:", _one("- candidate_blocks: ", F.col("n")), _one("- top_blocks_used: ", F.size("top")), "", "inferred:", "- prompt budget still exceeded after file and directory compaction", "", "unknown:",
        "- many lower-ranked details are omitted", "", "evidence:", "- ranked retrieval scores", "", "top_paths:", F.transform("top", lambda x: F.concat(F.lit("- "), x["file"], F.lit(" ("), F.format_string("%.3f", -x["s"]), F.lit(")"))),
        "", "sample:", F.array(sample), "", "confidence: low",
    )
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s - x["s"]) / F.size("top")
    return rows.select("query_id", F.lit("[repo_compaction_summary]").alias("file"), F.lit(".").alias("dir"), mean.alias("score"), F.lit(0).alias("ord"), F.lit("repo_compaction_summary").alias("node_type"), code.alias("code"))


def assemble(results: DataFrame, limits: dict = LIMITS["gemini"], strict_compat: bool = False) -> DataFrame:
    """``query_id, context, stage, blocks, raw_chars, estimated_tokens, truncated``: the first level within the limits.

    results: ``query_id, rank, file, node_type, code, score``. ``raw_chars`` and
    the tokens are those of the results as they are, whatever the stage.
    ``strict_compat`` shows a file's lowest score in directories. Scores are
    equal if they are to nine places, and then in the order of their ranks.
    """
    blocks = results.select("query_id", "file", directory(F.regexp_replace("file", r"\\", "/")).alias("dir"), F.round(F.col("score").cast("double"), 9).alias("score"), F.col("rank").alias("ord"), "node_type", F.coalesce("code", F.lit("")).alias("code"))
    files = _files(blocks, limits)
    dirs = _directories(files, limits, strict_compat)
    levels = {"none": blocks, "file": files, "directory": dirs, "repo": _repository(dirs, limits)}
    out = None
    for name, level in levels.items():
        text = _rendered(level, name)
        out = text if out is None else out.join(text, "query_id")
    fits = lambda c: (F.length(c) <= limits["max_chars"]) & (F.ceil(F.length(c) / 4) <= limits["max_tokens"])
    stage, context = F.lit("truncated"), F.concat(F.substring("repo", 1, limits["max_chars"]), F.lit("\n...(truncated)"))
    for name in reversed(levels):
        stage, context = F.when(fits(name), name).otherwise(stage), F.when(fits(name), F.col(name)).otherwise(context)
    return out.select("query_id", context.alias("context"), stage.alias("stage"), F.col("none_n").cast("long").alias("blocks"), F.length("none").cast("long").alias("raw_chars"), F.ceil(F.length("none") / 4).alias("estimated_tokens"), (stage == "truncated").alias("truncated"))
