"""Keys that find a row again when its text is read a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, r, p, text``: the row's key is 64 bits in ``r`` and 16 more in ``p``, of the id and the whole text."""
    id_, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_, text).alias("r"), F.xxhash64(text, id_).bitwiseAND(F.lit(0xFFFF)).alias("p"), F.col(text_col).alias("text"))
