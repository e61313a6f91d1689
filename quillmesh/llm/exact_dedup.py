"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by their length and then by successive blocks of bytes. A
group leaves the recursion when it holds one document or when its bytes have
ended; what is left together at the end is equal byte for byte. No digest
decides equality: Spark compares the blocks themselves when it groups by them.

Blocks grow by a factor from level to level, so the number of levels follows
the logarithm of the longest repeated text. Only documents whose bytes so far
equal another document's are carried to the next level. Grouping is a partial
aggregation and the way back to the rows is an ordinary shuffled join, which
adaptive execution splits where a group of copies is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.workspace import regrouped, stored

#: ASCII white space, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = 64, growth: int = 16) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised bytes are equal. ``keep_id`` is the
    smallest id of the group and ``group_size`` its number of rows.

    Edge cases: a null text counts as empty; a null id sorts after all others,
    so a group of null ids alone has a null ``keep_id``; rows that repeat an id
    are separate rows, and all rows that bear ``keep_id`` are marked as kept; an
    empty table gives no rows; other columns of ``docs`` are not read.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    state = text.select(
        "id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("rest")
    ).select("id", "sha", F.struct(F.length("rest").cast("long").alias("id"), F.lit("").alias("sha")).alias("bucket"), "rest")
    closed, block = [], first_block
    while True:
        keyed = state.select("id", "sha", "bucket", F.substring("rest", 1, block).alias("digit"), F.expr(f"substring(rest, {block + 1})").alias("rest"))
        # smallest id first, null ids last: the pair names the group at the next level
        named = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "sha"))), F.min(F.struct("id", "sha")))
        groups = keyed.groupBy("bucket", "digit").agg(named.alias("next"), F.count("*").alias("n"))
        level = keyed.join(regrouped(groups, "digit"), ["bucket", "digit"])
        open_ = (F.col("n") > 1) & (F.length("rest") > 0)
        level = stored(level.select("id", "sha", F.col("next").alias("bucket"), "n", F.when(open_, F.col("rest")).alias("rest")), "radix")
        closed.append(level.where("rest is null").select("id", "sha", F.col("bucket.id").alias("keep_id"), "n"))
        state = level.where("rest is not null").select("id", "sha", "bucket", "rest")
        if state.isEmpty():
            break
        block *= growth
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Edge cases as in ``radix_groups``: null and empty texts are equal; a group of
    null ids alone stays whole, as do rows that repeat the id that stays; a text
    of any length is compared whole; an empty table stays empty.
    """
    kept = radix_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
