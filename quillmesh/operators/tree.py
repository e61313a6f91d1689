"""The directories of a repository as a tree whose chains of only children are one node, with what lies below each.

Directories come from the paths, each file once for every directory above it,
and are counted by partial aggregation, so a root that holds all files is no
large group. Chains are followed by doubling the steps, so their number of
rounds is the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.workspace import stored

#: The states of a symbol, from the first to the last.
STATES = ("pending", "parsed", "embedding", "done")


def file_status(states: Column) -> Column:
    """The state of a file from those of its symbols; one without symbols has been parsed."""
    return F.when(F.size(states) == 0, "parsed").otherwise(F.when(F.forall(states, lambda s: s == "done"), "done").when(F.array_contains(states, "embedding"), "embedding").when(F.array_contains(states, "parsed"), "parsed").otherwise("pending"))


def _above(path: Column) -> Column:
    """All directories above a path, the root as the empty one first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _followed(links: DataFrame) -> DataFrame:
    """``repo, path, last``: where the chain of ``repo, path, next`` ends."""
    state = stored(links.select("repo", "path", F.col("next").alias("last")), "chains")
    while True:
        onward = state.select("repo", F.col("path").alias("last"), F.col("last").alias("further"))
        state = stored(state.join(onward, ["repo", "last"], "left").select("repo", "path", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved")), "chains")
        if state.where("moved").isEmpty():
            return state.select("repo", "path", "last")
        state = state.drop("moved")


def directory_tree(files: DataFrame) -> DataFrame:
    """``repo, path, name, parent, is_file, depth, n_files, n_symbols, n_chunks, status, place``: the nodes of each repository's tree.

    files: ``repo, path, states, chunks``, with the states of a file's symbols. A
    directory that holds one directory and no file is one node with it, named by
    both; the root too. A directory's counts and status are those of all files
    below it: done if all are, else embedding or parsed if any is, else pending.
    ``place`` orders a parent's nodes, directories first, each by name; ``depth``
    counts from the root. Paths that repeat are one file, and null ones none.
    """
    own = files.where("path is not null").groupBy("repo", "path").agg(F.flatten(F.collect_list("states")).alias("states"), F.sum("chunks").alias("chunks"))
    own = stored(own.select("repo", "path", file_status(F.col("states")).alias("status"), F.size("states").cast("long").alias("symbols"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks")), "files")
    held = own.withColumn("dir", F.explode(_above(F.col("path"))))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    has = lambda s: F.max(F.col("status") == s)
    status = F.when(F.min(F.col("status") == "done"), "done").when(has("embedding"), "embedding").when(has("parsed"), "parsed").otherwise("pending")
    dirs = stored(held.groupBy("repo", "dir").agg(F.count("*").alias("n_files"), F.sum("symbols").alias("n_symbols"), F.sum("chunks").alias("n_chunks"), F.count_if(F.col("dir") == folder).alias("direct"), status.alias("status")), "dirs")
    up = F.when(F.col("dir") != "", F.regexp_replace("dir", "/?[^/]*$", ""))
    children = dirs.where("dir <> ''").groupBy("repo", up.alias("path")).agg(F.count("*").alias("n"), F.min("dir").alias("next"))
    only = children.where("n = 1").join(dirs.where("direct = 0").select("repo", F.col("dir").alias("path")), ["repo", "path"]).select("repo", "path", "next")
    only = stored(only, "only-children")
    last = _followed(only)
    # the first of each chain stands for it, where the one above it isn't in a chain
    inner = only.select("repo", F.col("next").alias("dir"))
    heads = dirs.select("repo", "dir").join(inner, ["repo", "dir"], "left_anti").join(last.select("repo", F.col("path").alias("dir"), "last"), ["repo", "dir"], "left")
    shown = heads.select("repo", F.col("dir").alias("head"), F.coalesce("last", "dir").alias("path"))
    # what stands above a head isn't in a chain itself, or it would be joined to the head
    above = F.when(F.col("head") != "", F.regexp_replace("head", "/?[^/]*$", ""))
    ends = stored(shown.select("repo", "head", "path", above.alias("above")), "shown")
    ends = ends.join(ends.select("repo", F.col("path").alias("above"), F.col("path").alias("parent")), ["repo", "above"], "left")
    name = F.when((F.col("head") == ""), F.col("path")).when(F.col("above") == "", F.col("path")).otherwise(F.expr("substring(path, length(above) + 2)"))
    nodes = ends.select("repo", "path", name.alias("name"), "parent", F.lit(False).alias("is_file")).join(dirs.withColumnRenamed("dir", "path").drop("direct"), ["repo", "path"])
    leaves = own.select("repo", "path", F.substring_index("path", "/", -1).alias("name"), folder.alias("parent"), F.lit(True).alias("is_file"), F.lit(1).cast("long").alias("n_files"), F.col("symbols").alias("n_symbols"), F.col("chunks").alias("n_chunks"), "status")
    return _placed(nodes.unionByName(leaves))


def _placed(nodes: DataFrame) -> DataFrame:
    """With the depth of every node and its place among those of its parent: how many of them stand before it."""
    order = Window.partitionBy("repo", "parent").orderBy("is_file", "name")
    rows = stored(nodes.withColumn("place", F.row_number().over(order)), "nodes")
    dirs = rows.where("not is_file").select("repo", F.col("path").alias("dir"))
    depth = rows.select("repo", "path", "is_file", F.explode(_above(F.col("path"))).alias("dir")).where("dir <> path").join(dirs, ["repo", "dir"]).groupBy("repo", "path", "is_file").agg(F.count("*").alias("depth"))
    return rows.join(depth, ["repo", "path", "is_file"], "left").select("repo", "path", "name", "parent", "is_file", F.coalesce("depth", F.lit(0)).alias("depth"), "n_files", "n_symbols", "n_chunks", "status", F.col("place").cast("long").alias("place"))
