"""A corpus pipeline: reject toxic documents, drop repeated lines, keep one of
each group of near copies, mix the sources to their weights, and pack what is
left into training sequences.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import line_dedup, mixing, near_copies, packing, toxicity
from quillmesh.workspace import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic; it learns from the labels that are not held out.

    Edge cases: null and empty texts stay, as they have no hits; null ids and rows that repeat an id are judged by their
    own texts; an empty table stays empty; columns pass through, whatever their names.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least three of them hold, but for the last one; n_chars follows the text.

    Edge cases: a null text stays null, with the n_chars it had; a null id is smaller than every other; rows that repeat
    an id are documents of their own; an empty table stays empty; other columns pass through.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = docs.select(*own, F.struct(*(F.col(c) for c in docs.columns if c not in own)).alias("__own")) if len(own) < len(docs.columns) else docs
    out = line_dedup.dedup_lines(kept)
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(c) if c in own else F.col(f"__own.{c}").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a five-word Jaccard similarity of 0.8 or more join: the one of the smallest id.

    Edge cases: texts without words, null ones among them, are alike; rows without an id stay, as do rows that repeat the
    smallest id; an empty table stays empty; other columns pass through.
    """
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, again for every epoch that takes them, in a random order.

    Edge cases: documents without words go; a null source is one of its own; null and repeated ids count like others, and
    an empty table stays empty; other columns pass through.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    Edge cases: a null or empty text is the end id alone; null ids and rows that repeat an id are documents of their own;
    an empty table has no pieces; other columns are not read.
    """
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
