"""Secret scan with corpus-wide ownership of what it finds.

A scan of every text finds the base kinds by their patterns and, beside them,
other long tokens that look random. Every finding's value is hashed, and the
hashes are counted over the corpus by the distinct owners and repositories that
hold them. A value in the hands of many owners, or in very many repositories, is
a copied example; one that a few owners hold in a few repositories looks live.
Base findings are reported in any case; a token of no base kind is added only if
it looks live.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillmesh.llm.tokens import steps
from quillmesh.workspace import regrouped, stored

#: Kinds in the order of the report; the last is the added one.
KINDS = ("assign", "access", "hex", "owned")
#: The patterns of the base kinds. Letters of the keywords count in either case, ASCII only.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every match of ACCESS and HEX lies in one of these.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits of entropy a character from which a token of mixed classes looks random.
RANDOM_BITS = 3.2


def _looks_random(token: str) -> bool:
    classes = sum(any(test(c) for c in token) for test in (str.islower, str.isupper, str.isdigit))
    if classes < 2 or not any(c.isdigit() for c in token):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= RANDOM_BITS


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """``start, kind, end, value`` of every finding and candidate of a text, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    others = []
    for token in TOKEN.finditer(text):
        at = len(found)
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text, token.start(), token.end())]
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, token.start(), token.end())]
        if len(found) == at and _looks_random(token[0]):
            others.append((token.start(), 3, token.end(), token[0]))
    spans = [(s, e) for s, _, e, _ in found]
    return sorted(found + [x for x in others if not any(s < x[2] and x[0] < e for s, e in spans)])


def _findings(id_type: pa.DataType):
    from xxhash import xxh3_128_hexdigest

    item = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("h", pa.string())])

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in steps(batch, "text"):
                out = [[{"start": s, "kind": k, "end": e, "h": xxh3_128_hexdigest(v.encode())} for s, k, e, v in scan(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(out)), pa.int64()), part.column("id"), part.column("owner"), part.column("repository"), pa.array(out, pa.list_(item))], names=["row", "id", "owner", "repository", "found"])
                row += len(out)

    return run


def secret_report(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", wide_owners: int = 3, wide_repositories: int = 6) -> DataFrame:
    """One row per input row: counts, spans and how widely the values are held.

    ``id_col, n_assign, n_access, n_hex, n_added, base_spans, spans, n_live,
    n_copied, most_owners, most_repositories``. A value is live if fewer than
    ``wide_owners`` distinct owners and fewer than ``wide_repositories`` distinct
    repositories hold it, else copied. Spans are
    ``kind:start:end`` in code points, end exclusive, by start and then kind.

    Edge cases: a null text has no findings; a null owner or repository counts
    as one of its own; rows that repeat an id are rows of their own; an empty
    table gives no rows; other columns are not read. Long texts are scanned whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = StructField("id", docs.schema[id_col].dataType, True)
    item = StructType([StructField("start", LongType()), StructField("kind", LongType()), StructField("end", LongType()), StructField("h", StringType())])
    schema = StructType([StructField("row", LongType()), id_field, StructField("owner", StringType()), StructField("repository", StringType()), StructField("found", ArrayType(item))])
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), name(owner).alias("owner"), name(repository).alias("repository"))
    rows = stored(rows.mapInArrow(_findings(to_arrow_type(id_field.dataType)), schema), "findings")
    each = rows.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    held = each.select("h", "owner", "repository").distinct()
    owners = held.select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("owners"))
    places = held.groupBy("h").agg(F.count("*").alias("repositories"))
    judged = each.join(regrouped(owners.join(places, "h").where("owners >= 2 or repositories >= 2"), "h"), "h", "left")
    judged = judged.withColumn("owners", F.coalesce("owners", F.lit(1))).withColumn("repositories", F.coalesce("repositories", F.lit(1))).withColumn("live", (F.col("owners") < wide_owners) & (F.col("repositories") < wide_repositories))
    span = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("kind") + 1).cast("int")), "start", "end")
    kept = judged.where((F.col("kind") < 3) | F.col("live")).select("row", F.struct("start", "kind", "end").alias("key"), span.alias("span"), "kind", "live", "owners", "repositories")
    joined = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("key", "span")))), lambda x: x["span"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_added"))]
    report = kept.groupBy("row").agg(*counts, joined(F.col("kind") < 3).alias("base_spans"), joined(F.lit(True)).alias("spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    numbers = ("n_assign", "n_access", "n_hex", "n_added", "n_live", "n_copied", "most_owners", "most_repositories")
    return rows.select("row", "id").join(report, "row", "left").select(F.col("id").alias(id_col), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), *(F.coalesce(n, F.lit("")).alias(n) for n in ("base_spans", "spans")))
