"""Spelling variants: words that one edit separates, by a positional q-gram index.

One edit leaves either the first half of a word or all behind it as it was. So
words meet in a shard for their first half and in one for the rest. A shard's
words are indexed by their bigrams with length and place; a word asks for its
own bigrams among words of its length, and of one more at the same place or the
next. An edit destroys few of them: 2 of a substitution, 1 of an insertion into
the shorter word. The shortest lists that a match can't all miss are merged by a
heap, the counts are completed in the long lists by binary search, and what
reaches the bound is verified.

Shards hold words and their counts only. A large one is cut into blocks of words
that are indexed and blocks of words that ask, so no task holds a whole shard.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from heapq import merge
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import steps
from quillmesh.workspace import stored

#: Latin letters up to U+00FF, and the two signs among them.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
Q = 2
#: Words of a shard that are indexed, and that ask, in one block.
BLOCK = 4096
#: Rows of words that a task of the search reads, on average.
TASK_ROWS = 60_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
HEAD, TAIL = 0, 1


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, every: int = 199) -> DataFrame:
    """``word, n``: runs of letters with A-Z in lower case, counted over all texts.

    Where ``every`` divides the crc32 h of ``<id>:<run>``, the run loses its
    code point ``h % length``. Words below ``shortest`` code points are left out.
    """

    def batch_of(count):
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for part in steps(batch, "text"):
                for id_, text in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    for word, n in Counter(RUN.findall((text or b"").lower().decode())).items():
                        if len(word) >= shortest:
                            h = crc32(f"{id_}:{word}".encode())
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                            if len(word) >= shortest:
                                count[word] += n
                if len(count) >= COUNTED:
                    yield batch_of(count)
                    count.clear()
        if count:
            yield batch_of(count)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> int:
    """Where two different words, ``b`` as long as ``a`` or one longer, part if one edit separates them; else -1."""
    i, most = 0, len(a)
    while i < most and a[i] == b[i]:
        i += 1
    return i if a[i + (len(a) == len(b)) :] == b[i + 1 :] else -1


class Postings:
    """Sorted lists of word numbers by length, place and bigram."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.lists: dict[tuple[int, int, str], list[int]] = {}
        self.listed = 0

    def add(self, word: str, n: int) -> None:
        self.words.append((word, n))

    def _list(self) -> None:
        """Words that nobody asks for aren't listed."""
        for number in range(self.listed, len(self.words)):
            word = self.words[number][0]
            for at in range(len(word) - Q + 1):
                self.lists.setdefault((len(word), at, word[at : at + Q]), []).append(number)
        self.listed = len(self.words)

    def reaching(self, word: str, longer: int) -> list[int]:
        """Words of ``longer`` (0 or 1) more characters that share so many bigrams that one edit could separate them."""
        self._list()
        size, none = len(word), []
        places = range(size - Q + 1)
        bound = len(places) - (1 if longer else Q)  # what one edit leaves
        grams = [[found for shift in range(longer + 1) if (found := self.lists.get((size + longer, at + shift, word[at : at + Q]), none))] for at in places]
        grams.sort(key=lambda lists: sum(map(len, lists)))
        few, rest = grams[: len(places) - bound + 1], grams[len(places) - bound + 1 :]
        out = []
        for number, met in groupby(merge(*(x for lists in few for x in lists))):
            count = sum(1 for _ in met)
            for left, lists in zip(range(len(rest), 0, -1), rest):
                if count >= bound or count + left < bound:
                    break
                count += any((i := bisect_left(x, number)) < len(x) and x[i] == number for x in lists)
            if count >= bound:
                out.append(number)
        return out

    def near(self, word: str, side: int) -> list[tuple[str, int]]:
        """Indexed words one edit from ``word``, as long and greater or one longer, whose first change is on the other side than what the shard shares."""
        half, out = len(word) // 2, []
        for longer in (0, 1):
            for other, n in (self.words[i] for i in self.reaching(word, longer)):
                if longer or other > word:
                    at = one_edit(word, other)
                    if at >= 0 and (at >= half) == (side == HEAD):
                        out.append((other, n))
        return out


def _searched(batches):
    """Pairs of the sorted blocks: in each, the words to index come before those that ask."""
    block, index = None, None
    for batch in batches:
        found: list[tuple] = []
        for *key, asks, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "side", "size", "ib", "qb", "asks", "word", "n"))):
            if key != block:
                block, index = key, Postings()
            if asks:
                found += ((word, n, other, m) for other, m in index.near(word, key[1]))
            else:
                index.add(word, n)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64()) * 2)], names=["a", "na", "b", "nb"])


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, na, b, nb``: each pair of the distinct words ``word, n`` that one edit separates, once; ``b`` is the longer or the greater one.

    Words have at least ``Q + 2`` characters, of which one edit leaves a bigram.
    """
    size, own = F.char_length("word"), F.col("word")
    roles = [(0, 0), (0, 1), (1, 0)]  # (how much longer than those that ask, whether it asks)
    role = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.lit(longer).alias("longer"), F.lit(asks).alias("asks")) for side in (HEAD, TAIL) for longer, asks in roles)))
    rows = words.select("word", "n", role.alias("r")).select("word", "n", "r.side", "r.asks", (size - F.col("r.longer")).alias("size")).where("size >= 0")
    half = F.floor(F.col("size") / 2).cast("int")
    shared = F.when(F.col("side") == HEAD, F.substring(own, F.lit(1), half)).otherwise(F.substring(own, size - F.col("size") + half + 1, F.col("size")))
    rows = rows.withColumn("shard", F.xxhash64("side", "size", shared))
    blocks = lambda asks: F.ceil(F.count(F.when(F.col("asks") == asks, 1)) / block).cast("int")
    large = rows.groupBy("shard").agg(F.count("*").alias("held"), blocks(0).alias("nib"), blocks(1).alias("nqb")).where((F.col("held") > block) & (F.greatest("nib", "nqb") > 1)).select(F.col("shard").alias("s"), F.greatest("nib", F.lit(1)).alias("nib"), F.greatest("nqb", F.lit(1)).alias("nqb"))
    cut = rows.join(large, F.col("shard") == F.col("s"), "left").drop("s")
    number = lambda n: F.pmod(F.xxhash64("word"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    asks = F.col("asks") == 1
    cut = cut.withColumn("ib", F.explode(F.when(asks, every(F.col("nib"))).otherwise(F.array(number(F.col("nib"))))))
    cut = cut.withColumn("qb", F.explode(F.when(asks, F.array(number(F.col("nqb")))).otherwise(every(F.col("nqb")))))
    key = ["shard", "side", "size", "ib", "qb"]
    # by number, so that tasks of little data and much work aren't joined
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-6 * words.count() // TASK_ROWS))
    return cut.repartition(tasks, *key).sortWithinPartitions(*key, "asks").select(*key, "asks", "word", "n").mapInArrow(_searched, "a string, na long, b string, nb long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each ``word, form``: the last of the forms that follow, by doubling the steps."""
    state = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = state.select(F.col("word").alias("via"), F.col("root").alias("further"))
        state = stored(state.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, ratio: int = 5, every: int = 199, block: int = BLOCK) -> DataFrame:
    """One row per word of at least ``shortest`` code points and ``least`` occurrences: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent word one edit away, the smallest of equally
    frequent ones, if it has at least ``ratio`` times the occurrences; ``root`` is
    the last of the forms that follow, and the word itself without a form.

    Edge cases: a null or empty text has no words; a null id counts as an empty
    one in the checksum; rows that repeat an id or a text are counted each; a
    text or a run of any length is read whole; an empty table gives no rows;
    other columns are not read.
    """
    if shortest < Q + 2:
        raise ValueError("one edit could leave no bigram of shorter words")
    words = stored(corpus_words(docs, id_col, text_col, shortest, every).where(F.col("n") >= least), "words")
    pairs = stored(near_pairs(words, block), "near-words")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("w"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    named = words.join(best, F.col("word") == F.col("w"), "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "variants")
    roots = _roots(named.where("form is not null")).withColumnRenamed("word", "w")
    return named.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
