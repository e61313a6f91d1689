"""Quality rules with cutoffs that bound how many good documents they reject.

Rules are shares of a text: of symbols, capitals, marks, repeated lines and
words. Labelled rows are dealt into two parts by their ids. The tuning part
proposes, for each stratum, a path of rule sets from lenient to strict: at every
level each rule has the cutoff that pays best among those that reject at most
that level's share of good rows. The holdout part certifies: the false
rejections of a level, of all rules together, have an exact binomial
(Clopper-Pearson) upper bound, and the levels of a stratum are tested in their
order until one fails, so no correction is due within a stratum; the error that
is allowed is divided by the number of strata. So with a probability of
``1 - error`` no stratum loses more than ``limit`` of its good documents. A
stratum with too few labels to certify anything keeps what the base rules keep.

Cutoffs and counts cover all labelled rows as histograms over a fixed grid;
what is gathered is a number for each stratum, rule and bin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quillmesh.llm.tokens import steps
from quillmesh.workspace import stored

#: Words of a window that counts as repeated.
WINDOW = 8
#: Steps of the grid on which shares are laid, by their square roots.
GRID = 64
#: What the rules look at, each as a share of 0 to 1.
RULES = ("symbols", "capitals", "marks", "repeated lines", "repeated words", "doubled words", "long words", "short words")
#: Shares of the tuning part's good rows that one rule may reject, from level to level.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)
#: Bad rows that a rule has to reject for a good one.
PRICE = 3
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more; windows are equal by their words, not by a digest."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    rank = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    reach = 1
    while reach < window:  # numbers of longer and longer runs, from those of two shorter ones
        step = min(reach, window - reach)
        rank = np.unique(rank[:-step] * (len(words) + 1) + rank[step:], return_inverse=True)[1]
        reach += step
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures(text: bytes) -> tuple[list[int], list[int]]:
    """The five counts of a text in UTF-8, and the grid's step of each rule."""
    words, seen, dup, lines = text.split(), set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars, n = int(by.sum() - by[128:192].sum() - by[_SPACE].sum()), len(words)
    symbols, repeated = int(by[_SYMBOLS].sum()), repeated_words(words)
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    mean = chars / n if n else 0.0
    share = [symbols / max(chars, 1), int(by[65:91].sum()) / max(chars, 1), int(by[_MARKS].sum()) / max(chars, 1), dup / max(lines, 1), repeated / max(n, 1), doubled / max(n, 1), min(mean / 40, 1.0), max(0.0, 1 - mean / 8)]
    return [n, chars, symbols, dup, repeated], [math.isqrt(int(GRID * GRID * min(s, 1.0))) for s in share]


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id, stratum``, the five counts and ``bins`` of every row."""
    names = ["id", "stratum", *_COUNTS, "bins"]

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                got = [measures(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                counts = [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(_COUNTS))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("stratum"), *counts, pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=names)

    # a null stratum is one of its own
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("stratum", StringType()), *(StructField(c, LongType()) for c in _COUNTS), StructField("bins", ArrayType(IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for i in range(1, 100_000):
        for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of ``n`` trials."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # P(X <= k) = I_{1-p}(n-k, k+1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper bound of a share of which ``k`` of ``n`` were found, missed with a probability of ``error`` at most."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > error else (low, mid)
    return high


def _labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Measured rows with a label that the base rules keep: ``stratum, bins, good, tuning``. Labels that repeat an id count once, as good if any is."""
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y"))
    tuning = F.pmod(F.crc32(F.concat(F.lit("rules:"), F.col("id").cast("string")).cast("binary")), F.lit(2)) == 0
    return stats.where(~F.col("base_failed")).join(own, F.col("id") == F.col("lid")).select("stratum", "bins", (F.col("y") == 1).alias("good"), tuning.alias("tuning"))


def proposals(labelled: DataFrame, levels=LEVELS, price: int = PRICE) -> DataFrame:
    """``stratum, cuts``: for each rule the cutoff of each level, from which on bins are rejected; beyond the grid where a rule doesn't pay."""
    tuning = labelled.where("tuning")
    bins = tuning.select("stratum", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin")
    held = bins.agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    all_ = Window.partitionBy("stratum", "rule")
    sums = held.select("stratum", "rule", "bin", F.sum("good").over(above).alias("good"), F.sum("bad").over(above).alias("bad"), F.sum("good").over(all_).alias("total"))
    pays = (F.col("bad") - price * F.col("good")) > 0
    best = lambda share: F.max(F.when(pays & (F.col("good") <= share * F.col("total")), F.struct((F.col("bad") - price * F.col("good")).alias("net"), F.col("bin"))))["bin"]
    cuts = sums.groupBy("stratum", "rule").agg(F.array(*(F.coalesce(best(s), F.lit(GRID + 1)) for s in levels)).alias("at"))
    by_rule = [F.coalesce(F.max(F.when(F.col("rule") == r, F.col("at"))), F.array(*[F.lit(GRID + 1)] * len(levels))) for r in range(len(RULES))]
    return cuts.groupBy("stratum").agg(F.array(*by_rule).alias("cuts"))


def _level(levels: int):
    """The first level at which any rule rejects ``bins``; ``levels`` if none does."""
    first = F.zip_with("bins", "cuts", lambda b, at: F.size(F.filter(at, lambda c: c > b)))
    return F.coalesce(F.array_min(first), F.lit(levels))


def certified(labelled: DataFrame, cuts: DataFrame, limit: float, error: float, levels: int = len(LEVELS)) -> DataFrame:
    """``stratum, cuts, level, bound``: the strictest level up to which the holdout bounds false rejections by ``limit``, -1 if none, and its bound."""
    found = labelled.where("not tuning and good").join(cuts, "stratum").groupBy("stratum").agg(
        F.count("*").alias("n"), F.array(*(F.count(F.when(_level(levels) <= i, 1)) for i in range(levels))).alias("rejected")
    )
    strata = max(1, cuts.count())

    @F.pandas_udf("level int, bound double")
    def chosen(n: pd.Series, rejected: pd.Series) -> pd.DataFrame:
        out = []
        for n_, k in zip(n, rejected):
            bounds = [upper_bound(int(x), int(n_), error / strata) for x in k]
            passed = next((i for i, b in enumerate(bounds) if b > limit), len(bounds))
            out.append((passed - 1, bounds[passed - 1] if passed else None))
        return pd.DataFrame(out, columns=["level", "bound"])

    tested = found.select("stratum", chosen("n", "rejected").alias("c")).select("stratum", "c.level", "c.bound")
    return cuts.join(tested, "stratum", "left").select("stratum", "cuts", F.coalesce("level", F.lit(-1)).alias("level"), "bound")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", limit: float = 0.05, error: float = 0.05, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row per input row: ``id_col``, the five counts, ``base_failed, kept, stratum, bound``.

    ``kept`` is false where the base rules fail (fewer than ``least_words``
    words, or more than ``most_repeated`` percent of them in repeated windows)
    and where the stratum's certified rules reject; ``bound`` is the bound of the
    share of good documents that these reject, null where none is certified.

    Edge cases: a null or empty text has no words and fails; a null stratum is
    one of its own; null ids and rows that repeat an id are judged row by row,
    and a null id has no label; labels that repeat an id count once, as good if
    any is, and other values than 0 and 1 not at all; without labels the base
    rules alone decide; an empty table gives no rows; other columns are not read.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = stored(text_measures(docs, id_col, text_col, stratum_col).withColumn("base_failed", base), "measures")
    labelled = stored(_labelled(stats, labels, id_col, label_col), "labelled")
    rules = stored(certified(labelled, stored(proposals(labelled), "proposals"), limit, error), "rules")
    judged = stats.join(rules.withColumnRenamed("stratum", "s"), F.col("stratum") == F.col("s"), "left")
    rejected = F.coalesce(_level(len(LEVELS)) <= F.col("level"), F.lit(False))
    stratum = F.when(F.col("stratum") != "", F.substring("stratum", 2, 1 << 30))
    return judged.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), stratum.alias("stratum"), "bound")
