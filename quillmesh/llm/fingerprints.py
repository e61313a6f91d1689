"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form of a text is its Unicode NFC form, case-folded, normalised
again, with each run of white space folded into one space and none at the ends.
The fingerprint is wide: two xxhash64 values of the whole canonical text, which
name the document, and one value for each of four sections of it and of the
first sections of half that length, which tell how much of two documents that
differ is the same, even if one is so much shorter that its sections are. Documents are grouped by the
whole digest, and inside a digest that several documents share the canonical
bytes themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.workspace import regrouped, stored

SECTIONS = 4


def _icu(cls: str, method: str, text: Column, flag: bool) -> Column:
    """A static method of the Unicode library that Spark carries for its collations."""
    return F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """NFC, case-folded, white space folded; null is empty. ASCII needs no Unicode tables."""
    text = F.coalesce(text, F.lit(""))
    nfc = lambda x: _icu("text.Normalizer", "compose", x, False)
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfc(_icu("lang.UCharacter", "foldCase", nfc(text), True)))
    return F.trim(F.regexp_replace(folded, r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """144 hex digits of a canonical text: 32 of the whole, 16 of each section.

    A section is the largest power of two that fits into a text four times; the
    last one takes the rest. An edit then leaves the sections before it alone.
    The first three sections of half that length follow.
    """
    hex_ = lambda *x: F.lower(F.lpad(F.hex(F.xxhash64(*x)), 16, "0"))
    part = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.char_length(canon), F.lit(4)) / 4))).cast("int"))
    sections = [hex_(F.lit(2 + k), F.substr(canon, k * part + 1, part) if k < SECTIONS - 1 else F.substr(canon, k * part + 1)) for k in range(SECTIONS)]
    half = F.floor(part / 2).cast("int")
    halves = [hex_(F.lit(2 + k), F.substr(canon, k * half + 1, half)) for k in range(SECTIONS - 1)]
    return F.concat(hex_(canon), hex_(F.lit(1), canon), *sections, *halves)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the part of the sections that are equal, at the best of the lengths that both can have."""
    at = lambda x, k: F.substring(x, 33 + 16 * k, 16)
    same = lambda n, i, j: sum((at(a, i + k) == at(b, j + k)).cast("int") for k in range(n))
    best = F.greatest(same(SECTIONS, 0, 0), same(SECTIONS - 1, SECTIONS, 0), same(SECTIONS - 1, 0, SECTIONS))
    return F.when(a == b, F.lit(1.0)).otherwise(best / F.lit(float(SECTIONS)))


def fingerprinted(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text as column ``name``."""
    return docs.withColumn("__canon", canonical(F.col(text_col))).withColumn(name, digest(F.col("__canon"))).drop("__canon")


def suspects(prints: DataFrame) -> DataFrame:
    """``sk``: the keys of the rows ``k, fp`` whose whole digest is not alone. Narrow rows only."""
    alone = prints.select("k", F.substring("fp", 1, 32).alias("d"))
    shared = alone.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    return alone.join(regrouped(shared, "d"), "d").select(F.col("k").alias("sk")).distinct()


def equal_groups(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group_id, group_size`` of equal canonical texts; rows: ``id, fp, canon``, the last one null where the digest is alone.

    Inside a digest that several documents share, grouping compares the bytes
    themselves; it is a partial aggregation, so a large group of copies is
    combined where it is read, and its rows are joined by the bytes' digest and
    then by the bytes.
    """
    shared = rows.where("canon is not null").withColumn("d", F.substring("fp", 1, 32))
    groups = shared.groupBy("d", "canon").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    same = shared.join(regrouped(groups, "d"), ["d", "canon"]).drop("d")
    single = rows.where("canon is null").withColumns({"group_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    return single.unionByName(same)


def _neighbours(prints: DataFrame) -> DataFrame:
    """``nk, fp, prev_k, prev_n``: the document before each in ascending order of ids; the last is before the first.

    Narrow rows only are sorted: ranges of ids are windows of their own, and one
    row for each range links it with the range before.
    """
    narrow = prints.distinct().repartitionByRange(F.col("id").asc_nulls_first(), "k")
    ranged = stored(narrow.withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "k")
    ends = ranged.groupBy("part").agg(F.max_by(F.struct("k", "n"), F.struct(F.col("id").isNotNull(), "id", "k")).alias("last"))
    over, all_ = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(all_)).alias("before"))
    # one row for each range: as many as partitions
    rows = ranged.withColumn("prev", F.lag(F.struct("k", "n")).over(inside)).join(F.broadcast(ends), "part")
    prev = F.coalesce("prev", "before")
    return rows.select(F.col("k").alias("nk"), "fp", prev["k"].alias("prev_k"), prev["n"].alias("prev_n"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has its last quarter of code points, rounded down, replaced
    by the first as many (or all) of the next document in ascending order of
    ids; after the last comes the first. One row per input row: ``id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, group_id, group_size``; ``group_id`` is the smallest id of equal
    canonical texts.

    Edge cases: a null text counts as empty; null ids come first; rows that
    repeat an id follow each other by a hash of their texts, equal rows count as
    one document and get equal results; of one document the next is itself; an
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text).cast("string")).alias("k"), F.char_length(text).cast("long").alias("n"))
    prints = stored(fingerprinted(rows, "text", "fp").select("k", "id", "n", "fp"), "prints")
    before = stored(_neighbours(prints).join(suspects(prints), F.col("nk") == F.col("sk"), "left"), "neighbours")
    # texts are shuffled by their key once: both sides below use the same columns of them, so that exchange is read twice
    located = rows.select("k", "id", "text", "n").join(before, F.col("k") == F.col("nk"))
    # a document's head goes to the one before it, no longer than that one needs
    heads = located.select("prev_k", F.struct(F.left("text", F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), "fp", "id", "n").alias("next"))
    heads = heads.groupBy("prev_k").agg(F.first("next").alias("next")).withColumnRenamed("prev_k", "hk")
    quarter = F.floor(F.col("n") / 4)
    edited = located.join(heads, F.col("k") == F.col("hk")).withColumn("edited", F.concat(F.left("text", (F.col("n") - quarter).cast("int")), F.col("next.head")))
    edited = edited.withColumn("canon", F.when(F.col("sk").isNotNull(), canonical(F.col("text")).cast("binary")))
    rows = stored(fingerprinted(edited, "edited", "efp").select("id", "n", F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp", F.col("next.fp").alias("next_fp"), "canon"), "fingerprints")
    grouped = equal_groups(rows)
    return grouped.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "group_id", "group_size",
    )
