"""Totals of metric events, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame) -> DataFrame:
    """One row of counters. events: ``type, durationMs, provider, tokensIn, tokensOut, chunks, files, blocked, redactedChunks``."""

    def n(kind, more=None) -> Column:
        c = F.col("type") == kind
        return F.count_if(c & more if more is not None else c)

    def s(kind, col) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col(col))), F.lit(0))

    provider = F.col("provider")
    return events.agg(
        n("llm").alias("llm_calls"), *(n("llm", provider == p).alias(f"{p}_calls") for p in ("gemini", "groq", "mlc")), s("llm", "tokensIn").alias("tokens_in"), s("llm", "tokensOut").alias("tokens_out"), s("llm", "durationMs").alias("llm_ms"),
        n("embed").alias("embed_calls"), s("embed", "durationMs").alias("embed_ms"), s("embed", "chunks").alias("chunks_embedded"), n("index").alias("index_calls"), s("index", "durationMs").alias("index_ms"), s("index", "files").alias("files_indexed"),
        n("search").alias("search_calls"), s("search", "durationMs").alias("search_ms"), n("safety").alias("injection_scans"), n("safety", F.col("blocked")).alias("injection_blocks"), s("safety", "redactedChunks").alias("redacted_chunks"),
    )


def shares(total: DataFrame) -> DataFrame:
    """Rounded percentages of the providers and of the tokens; the second token share is what is left of 100."""
    part = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b))).otherwise(0).cast("long")
    t = total.withColumn("tokens", F.col("tokens_in") + F.col("tokens_out")).withColumn("in_pct", part("tokens_in", "tokens"))
    return t.select(*(part(f"{p}_calls", "llm_calls").alias(f"{p}_pct") for p in ("gemini", "groq", "mlc")), "in_pct", F.when(F.col("tokens") > 0, 100 - F.col("in_pct")).otherwise(0).alias("out_pct"))


def recent(events: DataFrame, most: int = 200, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """The last ``most`` events: what a ring buffer of that size holds."""
    return events.orderBy(F.desc(ts), F.desc(id_col)).limit(most)
