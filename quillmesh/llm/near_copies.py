"""SimHash near-dedup at a similarity: multi-index hashing verified by exact Jaccard.

Here pairs count by the Jaccard similarity of their sets of word shingles. Two
sets of a similarity of 0.8 have a cosine of 0.889, so a bit of a fingerprint
differs with a probability of acos(0.889) / pi = 0.15: far more than the bits of
``simhash.near_groups``. The fingerprint has therefore 1,536 bits or more, with as
many segments as find 0.995 of such pairs. Distances are verified over a word of
64 bits where every bucket is gone through, and over 1,536 bits where pairs of a
bucket are, so that texts which are less alike don't become pairs. In a segment the small ball around its value is enumerated over the bits
that the fewest shingles decided, as those are the ones that differ, and two
texts meet where their balls do. Segments are three bits wider than the number
of texts, so what meets by chance stays a part of the texts at every size, and
their number follows from their width.

What meets and is close is then held against each other by the whole sets.
Texts with the same set are one class. In a bucket every class is first held
against one head: where many have met, that in the middle of them, to which the
copies of one text are more alike than to each other. What those links don't
join is then held against all others of the bucket, so a bucket's pairs are left
out only where their classes are joined already.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillmesh.llm.components import connected
from quillmesh.llm.rows import keyed
from quillmesh.llm.simhash import shingle_hashes, votes
from quillmesh.llm.tokens import steps
from quillmesh.workspace import discard, regrouped, stored

#: Bits of a segment that are flipped, one at a time.
FLIPPED = 4
#: Bits of the verified word that differ at most: at a similarity of 0.8, 9.7 in the mean with a deviation of 2.9.
MOST = 21
#: Words of 64 bits whose whole distance is verified, and bits of them that differ at most: three and a half deviations above the mean.
WIDE = 24
MOST_WIDE = math.floor(64 * WIDE * 0.1515 + 3.5 * math.sqrt(64 * WIDE * 0.1515 * 0.8485))
#: Classes in a bucket from which its head is the one in the middle.
CROWDED = 8
#: Widths of a segment: below the narrowest, few texts need no fewer; the widest leaves room for the segment's number.
NARROWEST, WIDEST = 14, 40


def layout(n: int) -> tuple[int, int]:
    """Width and number of the segments for ``n`` texts.

    By simulation of normal votes, segments of 16, 20, 24, 28 and 32 bits meet
    with a probability of 0.467, 0.297, 0.180, 0.104 and 0.059 at a similarity
    of 0.8; 9, 16, 27, 49 and 87 of them find 0.995. The formula lies above.
    """
    width = min(WIDEST, max(NARROWEST, math.ceil(math.log2(max(n, 2))) + 3))
    return width, math.ceil(10 * 2 ** ((width - 16) / 4.9))


def _words(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` words for each hash."""
    x = hashes[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The verified words, signed, of a set of shingles that isn't empty, and the keys of the balls of its segments."""
    k = max(WIDE, 1 + -(-width * segments // 64))
    total = np.zeros(64 * k, np.int64)
    for at in range(0, len(hashes), 8192):  # bounds the arrays of a very long text
        total += votes(_words(hashes[at : at + 8192], k))
    margin = 2 * total - len(hashes)
    wide = np.packbits(margin[: 64 * WIDE] > 0, bitorder="little").view("<i8")
    margin = margin[64 : 64 + width * segments].reshape(segments, width)
    value = (margin > 0).astype(np.int64) @ (np.int64(1) << np.arange(width))
    ball = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :FLIPPED]
    values = np.column_stack([value, value[:, None] ^ (np.int64(1) << ball)])
    return wide, (values | (np.arange(segments)[:, None] << WIDEST)).ravel()


def prints(texts: DataFrame, words: int, width: int, segments: int) -> DataFrame:
    """``id, r, p, set, n, fp, wide, keys``: a digest of the set of shingles and its size, the first of the verified words and all of them, the segments' keys."""
    from xxhash import xxh3_128_digest

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                found = [np.unique(shingle_hashes(t or b"", words, 42)) for t in part.column("text").cast(pa.binary()).to_pylist()]
                made = [fingerprint(h, width, segments) if len(h) else (np.zeros(WIDE, np.int64), []) for h in found]
                columns = [
                    *(part.column(c) for c in ("id", "r", "p")), pa.array([xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int64()),
                    pa.array([int(m[0][0]) for m in made], pa.int64()), *(pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in (0, 1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "r", "p", "set", "n", "fp", "wide", "keys"])

    long_ = lambda n: StructField(n, LongType())
    return texts.mapInArrow(run, StructType([texts.schema["id"], long_("r"), long_("p"), StructField("set", BinaryType()), long_("n"), long_("fp"), StructField("wide", ArrayType(LongType())), StructField("keys", ArrayType(LongType()))]))


def _alike(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``a, b`` of the pairs whose sets have a Jaccard similarity of ``least`` or more; only the texts of pairs are read again."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                found = [np.unique(shingle_hashes(t or b"", words, 42)).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    near = stored(pairs.distinct(), "near")
    needed = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", F.col("r").alias("nr"), F.col("p").alias("np")), "node")
    located = texts.join(needed, (F.col("r") == F.col("nr")) & (F.col("p") == F.col("np"))).select("node", "text").dropDuplicates(["node"])
    read = stored(located.mapInArrow(run, "node long, hashes array<long>"), "sets")
    whole = lambda s: read.select(F.col("node").alias(s), F.col("hashes").alias(f"h{s}"))
    both = near.join(whole("a"), "a").join(whole("b"), "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("common") >= F.lit(least) * (F.size("ha") + F.size("hb") - F.col("common"))).select("a", "b")


def _middle(crowded: DataFrame) -> DataFrame:
    """``hk, head, hfp, hn``: of each key, the class whose word is closest to the bits that most words of the key have."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    sums = crowded.groupBy("key").agg(F.count("*").alias("c"), *ones)
    signed = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    most = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"b{i}") * 2 > F.col("c"), F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for i, v in enumerate(signed)))
    far = crowded.join(regrouped(sums.select(F.col("key").alias("mk"), most.alias("most")), "mk"), F.col("key") == F.col("mk"))
    best = far.groupBy("key").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("most"))).alias("d"), "node", "fp", "n")).alias("m"))
    return best.select(F.col("key").alias("hk"), F.col("m.node").alias("head"), F.col("m.fp").alias("hfp"), F.col("m.n").alias("hn"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``id_col, component_id`` of every row; the smallest id that pairs of a similarity of ``least`` or more reach.

    Edge cases: a null text counts as empty, and texts without words are alike;
    a null id is never a component's id unless all of its ids are null; rows
    that repeat an id are rows of their own; an empty table gives no rows; other
    columns are not read.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the segments are laid out for similarities of 0.8 and more")
    texts = keyed(docs, id_col, text_col)
    width, segments = layout(docs.count())
    rows = stored(prints(texts, words, width, segments), "prints")
    classes = stored(rows.select("r", "p", "set", "n", "fp", "wide", "keys").dropDuplicates(["set"]).withColumn("node", F.monotonically_increasing_id()), "classes")
    sets = stored(rows.select("id", "set"), "sets-of-rows")
    discard(rows)
    member = classes.select("node", "n", "fp", F.explode("keys").alias("key"))
    heads = member.groupBy("key").agg(F.min("node").alias("head"), F.min_by("fp", "node").alias("hfp"), F.min_by("n", "node").alias("hn"), F.count("*").alias("held")).where("held > 1").withColumnRenamed("key", "hk")
    shared = stored(member.join(regrouped(heads, "hk"), F.col("key") == F.col("hk")).select("node", "n", "fp", "key", "head", "hfp", "hn", "held"), "buckets")
    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MOST
    sized = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y)  # noqa: E731, sets of other sizes can't be as alike
    crowded = shared.where(F.col("held") > CROWDED).select("node", "n", "fp", "key")
    met = crowded.join(regrouped(_middle(crowded), "hk"), F.col("key") == F.col("hk")).unionByName(shared.where(F.col("held") <= CROWDED).drop("held").withColumn("hk", F.col("key")))
    pairs = met.where((F.col("node") != F.col("head")) & close("fp", "hfp") & sized("n", "hn")).select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    first = stored(_alike(pairs, classes, texts, words, least), "links")
    roots = connected(first)
    # in a bucket of two both have met
    at = shared.where("held > 2").join(regrouped(roots.withColumnRenamed("node", "x"), "x"), F.col("node") == F.col("x"), "left").select("node", "n", "fp", "key", F.coalesce("root", "node").alias("root"))
    at = stored(at, "rooted")
    discard(shared)
    # buckets that are not joined to one component: what is outside the largest one meets all others
    counts = at.groupBy("key", "root").agg(F.count("*").alias("c"))
    split = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select(F.col("key").alias("hk"), "major")
    left = at.join(regrouped(split, "hk"), F.col("key") == F.col("hk")).select("node", "n", "key", "root", "major")
    left = stored(left.join(classes.select(F.col("node").alias("x"), "wide"), F.col("node") == F.col("x")).drop("x"), "unjoined")
    one = left.where("root <> major").select("key", F.col("node").alias("na"), F.col("n").alias("sa"), F.col("wide").alias("wa"), F.col("root").alias("ra"))
    other = left.select("key", F.col("node").alias("nb"), F.col("n").alias("sb"), F.col("wide").alias("wb"), F.col("root").alias("rb"))
    differ = sum((F.bit_count(F.get("wa", F.lit(i)).bitwiseXOR(F.get("wb", F.lit(i)))) for i in range(WIDE)), F.lit(0))
    cross = one.join(other, "key").where((F.col("ra") != F.col("rb")) & sized("sa", "sb") & (differ <= MOST_WIDE)).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    roots = connected(first.unionByName(_alike(cross, classes, texts, words, least)))
    named = classes.select("set", "node").join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select(F.col("set").alias("s"), F.coalesce("root", "node").alias("root"))
    ids = stored(sets.join(regrouped(named, "s"), F.col("set") == F.col("s")).select("id", "root"), "ids")
    smallest = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    return ids.join(regrouped(smallest, "root"), "root").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; rows without an id stay.

    Edge cases as in ``near_groups``; of rows that repeat an id, all stay whose
    id is the smallest of a group. All columns pass through, whatever their names.
    """
    kept = near_groups(docs, id_col, text_col, **options).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct().alias("kept")
    own = docs.alias("docs")
    return own.join(kept, F.col(f"docs.`{id_col}`") == F.col("kept.id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
