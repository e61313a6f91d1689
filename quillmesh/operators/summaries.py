"""Aggregates over directories, the page index and its search, and storage inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import summary_tokens
from quillmesh.operators.paths import directory
from quillmesh.workspace import stored

#: Limits: files and characters of a directory, and characters of a summary.
DIRECTORY_LIMITS = {"files": 120, "chars": 400_000, "summary": 20_000}
TOP_FILES = 12


def directory_stats(files: DataFrame) -> DataFrame:
    """``repo, dir, file_count, total_chars`` of each directory's own files. files: ``repo, path, chars, chunks, has_summary``."""
    return files.groupBy("repo", directory(F.col("path")).alias("dir")).agg(F.count("*").alias("file_count"), F.sum("chars").alias("total_chars"))


def directory_summaries(files: DataFrame, limits: dict = DIRECTORY_LIMITS) -> DataFrame:
    """A text chunk for each directory that holds too much: ``repo, dir, file_count, total_chars, omitted, code``.

    The largest files come from a ranked window, so a directory's list never
    has more than those.
    """
    rows = files.withColumn("dir", directory(F.col("path")))
    over = directory_stats(files).where((F.col("file_count") > limits["files"]) | (F.col("total_chars") > limits["chars"]))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo", "dir").orderBy(F.desc("chars"), "path"))).where(F.col("n") <= TOP_FILES)
    line = F.format_string("- %s (%d chars, %d chunks%s)", F.col("path"), F.col("chars"), F.col("chunks"), F.when(F.col("has_summary"), ", file-summary").otherwise(""))
    tops = best.groupBy("repo", "dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("top"))
    joined = over.join(tops, ["repo", "dir"])
    omitted = F.col("file_count") - F.size("top")
    none = F.array().cast("array<string>")
    # fixed values: the lines of this summary are output text that has to match
    parts = F.concat(
        F.array(F.lit("[DIRECTORY_SUMMARY]"), F.concat(F.lit("directory: "), "dir"), F.lit(""), F.lit("known:"), F.concat(F.lit("- file_count: "), F.col("file_count").cast("string")), F.concat(F.lit("- total_chars: "), F.col("total_chars").cast("string")),
                F.concat(F.lit("- overflow_reason: "), F.when(F.col("file_count") > limits["files"], "too many files").otherwise("too many chars")),
                F.lit(""), F.lit("inferred:"), F.lit("- this directory likely includes high-volume assets or generated content"), F.lit(""), F.lit("unknown:"), F.lit("- full semantics of omitted files are not included in this summary"),
                F.lit(""), F.lit("evidence:"), F.lit("- indexing-time directory aggregate statistics"), F.concat(F.lit("- top_files_by_size_sample_count: "), F.size("top").cast("string")), F.lit(""), F.lit("top_files_by_size:")),
        F.col("top"), F.when(omitted > 0, F.array(F.format_string("- ...(omitted %d files)", omitted))).otherwise(none), F.array(F.lit(""), F.lit("confidence: medium")),
    )
    return joined.select("repo", "dir", "file_count", "total_chars", omitted.cast("long").alias("omitted"), F.substring(F.array_join(parts, "\n"), 1, limits["summary"]).alias("code"))


#: Characters of summaries in the page index: of files, of a first chunk, of directories and of the root.
FILE_CHARS, FIRST_CHARS, DIR_CHARS, ROOT_CHARS, ROOT_DIRS, ROOT_PART = 600, 500, 400, 800, 15, 60


def _file_nodes(chunks: DataFrame) -> DataFrame:
    summary = F.col("node_type") == "file_summary"
    regular = ~F.col("node_type").isin("file_summary", "directory_summary")
    files = chunks.groupBy("repo", "path").agg(
        F.max_by(F.when(summary, F.col("code")), F.when(summary, F.length("code"))).alias("own"), F.min_by(F.when(regular, F.col("code")), F.when(regular, F.col("ord"))).alias("first"),
        F.count_if(regular).alias("n_chunks"), F.min(F.when(regular, F.col("ord"))).alias("ord"),
    ).where("n_chunks > 0")
    return files.select("repo", F.lit(2).alias("level"), "path", directory(F.col("path"), "").alias("parent"), F.coalesce(F.substring("own", 1, FILE_CHARS), F.substring("first", 1, FIRST_CHARS)).alias("summary"), "n_chunks", "ord")


def _summary_dir() -> Column:
    """The directory that a chunk of a summary of a directory is about."""
    return F.coalesce(F.nullif(directory(F.col("path"), ""), F.lit("")), F.replace(F.replace(F.col("path"), F.lit("/[directory_summary]"), F.lit("")), F.lit("[directory_summary]"), F.lit("")))


def _dir_nodes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Directories of file nodes, with their own summaries out of the chunks where there are any."""
    name = F.substring_index("path", "/", -1)
    # every name takes a character at least, so more than DIR_CHARS names are never shown: the rest leave before the list is made
    ranked = files.withColumn("name", name).withColumn("n", F.row_number().over(Window.partitionBy("repo", "parent").orderBy("ord", "name"))).where(F.col("n") <= DIR_CHARS)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ")
    lists = ranked.groupBy("repo", "parent").agg(F.substring(F.concat(F.lit("Contains: "), listed), 1, DIR_CHARS).alias("listed"))
    own = chunks.where("node_type = 'directory_summary' and code <> ''").groupBy("repo", _summary_dir().alias("parent")).agg(F.substring(F.max_by("code", F.struct(F.length("code"), "code")), 1, FILE_CHARS).alias("own"))
    dirs = files.groupBy("repo", "parent").agg(F.sum("n_chunks").alias("n_chunks"), F.min("ord").alias("ord")).join(lists, ["repo", "parent"]).join(own, ["repo", "parent"], "left")
    return dirs.select("repo", F.lit(1).alias("level"), F.col("parent").alias("path"), F.lit("").alias("parent"), F.coalesce("own", "listed").alias("summary"), "n_chunks", "ord")


def _root_nodes(dirs: DataFrame) -> DataFrame:
    shown = dirs.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("ord")))
    line = F.concat("path", F.lit(": "), F.substring("summary", 1, ROOT_PART))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= ROOT_DIRS, F.struct("n", line.alias("line"))))), lambda x: x["line"])
    root = shown.groupBy("repo").agg(F.substring(F.array_join(parts, "\n"), 1, ROOT_CHARS).alias("summary"), F.sum("n_chunks").alias("n_chunks"), F.min("ord").alias("ord"))
    return root.select("repo", F.lit(0).alias("level"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), "summary", "n_chunks", "ord")


def page_index(chunks: DataFrame) -> DataFrame:
    """``repo, level, path, parent, summary, n_chunks, ord``: files, directories and the root of each repository.

    chunks: ``repo, path, ord, node_type, code``. A file's summary is its longest
    summary chunk or the beginning of its first chunk; a directory's is its
    longest summary chunk or the list of its files.
    """
    files = _file_nodes(chunks)
    dirs = _dir_nodes(files, chunks)
    return files.unionByName(dirs).unionByName(_root_nodes(dirs))


def updated_page_index(nodes: DataFrame, chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """The page index after changes, from the one before: the same rows as ``page_index`` makes of all chunks.

    nodes: the index before; chunks: those after; touched: ``repo, path`` of files
    that were added, changed or removed, and of changed summaries of directories.
    Only the touched files' chunks are read, their directories are made anew out
    of the nodes of their files, and the root out of the directories.
    """
    files_t = stored(touched.select("repo", "path").distinct(), "touched")
    dirs_t = stored(files_t.select("repo", F.when(F.endswith("path", F.lit("[directory_summary]")), _summary_dir()).otherwise(directory(F.col("path"), "")).alias("path")).distinct(), "touched-dirs")
    at = ["repo", "path"]
    files = stored(nodes.where("level = 2").join(files_t, at, "left_anti").unionByName(_file_nodes(chunks.join(files_t, at, "left_semi"))), "file-nodes")
    inside = files.join(dirs_t.withColumnRenamed("path", "parent"), ["repo", "parent"], "left_semi").select(files.columns)
    own = chunks.where("node_type = 'directory_summary'").withColumn("__dir", _summary_dir()).join(dirs_t.withColumnRenamed("path", "__dir"), ["repo", "__dir"], "left_semi").drop("__dir")
    dirs = stored(nodes.where("level = 1").join(dirs_t, at, "left_anti").select(files.columns).unionByName(_dir_nodes(inside, own)), "dir-nodes")
    return files.unionByName(dirs).unionByName(_root_nodes(dirs))


def updated_directory_stats(stats: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``repo, dir, file_count, total_chars`` after changes: what the changed files were is taken back and what they are is added.

    stats: as ``directory_stats`` makes them; before and after: the changed files,
    ``repo, path, chars``, as they were and as they are. A directory without
    files goes. Sums of differences commute, so changes can come in any order.
    """
    signed = lambda files, sign: files.select("repo", directory(F.col("path")).alias("dir"), F.lit(sign).cast("long").alias("file_count"), (sign * F.col("chars")).alias("total_chars"))
    changed = signed(before, -1).unionByName(signed(after, 1)).groupBy("repo", "dir").agg(F.sum("file_count").alias("file_count"), F.sum("total_chars").alias("total_chars"))
    return stats.unionByName(changed).groupBy("repo", "dir").agg(F.sum("file_count").alias("file_count"), F.sum("total_chars").alias("total_chars")).where("file_count > 0")


def updated_directory_summaries(summaries: DataFrame, files: DataFrame, touched: DataFrame, limits: dict = DIRECTORY_LIMITS) -> DataFrame:
    """``directory_summaries`` of ``files`` after changes: those of touched directories are made anew, the others stay."""
    dirs = stored(touched.select("repo", directory(F.col("path")).alias("dir")).distinct(), "touched-dirs")
    own = files.withColumn("__dir", directory(F.col("path"))).join(dirs.withColumnRenamed("dir", "__dir"), ["repo", "__dir"], "left_semi").drop("__dir")
    return summaries.join(dirs, ["repo", "dir"], "left_anti").unionByName(directory_summaries(own, limits))


def page_index_search(nodes: DataFrame, queries: DataFrame, dirs: int = 3, files: int = 2) -> DataFrame:
    """``query_id, repo, path``: the files that a walk from the root reaches, by how many query tokens the summaries hold.

    nodes: as ``page_index`` makes them; queries: ``query_id, repo, text``. The
    summaries of a repository meet its queries only, and texts join at the end.
    """
    asked = queries.select("query_id", "repo", summary_tokens(F.col("text")).alias("tokens"))
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.lower(F.col("summary")), t)))

    def best(rows, by, n):
        w = Window.partitionBy(*by).orderBy(F.desc("hits"), "ord", "path")
        return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)

    chosen = best(nodes.where("level = 1").join(asked, "repo").withColumn("hits", hits), ["query_id", "repo"], dirs)
    under = nodes.where("level = 2").join(chosen.select("query_id", "repo", "tokens", F.col("path").alias("parent")), ["repo", "parent"]).withColumn("hits", hits)
    return best(under, ["query_id", "repo", "parent"], files).select("query_id", "repo", "path", F.col("hits").cast("long").alias("hits"))


def storage_inventory(chunks: DataFrame, bytes_each: int = 3672) -> DataFrame:
    """``repo, chunks, files, bytes``, the largest first. chunks: ``repo, path``."""
    return chunks.groupBy("repo").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files")).withColumn("bytes", F.col("chunks") * bytes_each)


def index_bytes(chunks, dims: int = 384):
    """Estimated bytes of an index of so many chunks: numbers of 8 bytes and 1,500 bytes of text."""
    return chunks * (dims * 8 + 1500)


def file_groups(symbols: DataFrame) -> DataFrame:
    """``repo, path, symbols`` with the symbols of a file in the order of their lines."""
    return symbols.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("symbols"))


#: The kinds that node types stand for.
KINDS = {
    "function_declaration": "function", "function_definition": "function", "function_item": "function", "arrow_function": "function", "method_definition": "method", "method_declaration": "method",
    "class_declaration": "class", "class_definition": "class", "class_specifier": "class", "struct_item": "struct", "struct_specifier": "struct", "enum_item": "enum", "enum_declaration": "enum",
    "impl_item": "impl", "interface_declaration": "interface", "type_alias_declaration": "type", "type_declaration": "type",
}


def symbol_kinds(chunks: DataFrame) -> DataFrame:
    """``repo, path, kind, n``: symbols of each file by kind, out of the node types of its chunks; text chunks have none."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("node_type"))
    return chunks.where(~F.startswith("name", F.lit("chunk_"))).withColumn("kind", kind).where("kind is not null").groupBy("repo", "path", "kind").agg(F.count("*").alias("n"))


def file_progress(ranges: DataFrame, embedded: int) -> DataFrame:
    """``path, status`` from the range of chunks of each file and how many chunks are embedded so far."""
    return ranges.select("path", F.when(F.col("last") <= embedded, "done").when(F.col("first") < embedded, "embedding").otherwise("parsed").alias("status"))
