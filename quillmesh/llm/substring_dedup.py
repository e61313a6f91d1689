"""Suffix dedup: bytes covered by long strings that repeat anywhere are removed.

A radix sort of suffixes by their first ``width`` bytes only, most significant
digits first. A pass groups by its digit and what is left alone leaves, so what
is left together at the end is exactly the repeated windows. Digits are blocks
of the window, the most telling one first: its anchor, the gram inside it with
the smallest hash. Windows that follow each other mostly share their anchor;
they travel as one row, a bundle, as long as their digits agree.

1. by the anchor: an anchor found once has no repeated window;
2. by all bytes of the bundle: a bundle found twice repeats as a whole. Its
   rows travel under a number of 128 bits, and the bytes behind each number are
   grouped as well: a number that stands for two strings is drawn anew. Where
   all bundles of a number are followed by bundles of one number, their last
   bytes are the next ones' first, so only the bytes before those are compared;
3. the rest by the bytes of the single windows. Groups of up to ``small``
   different bundles are compared byte by byte in one place, so that no larger
   group has to fit anywhere;
4. larger groups by octets, the windows of a bundle at eight places in a row
   before the anchor: by the bytes that all eight share, and by all their bytes.
   An octet that is found twice repeats as a whole, one whose shared bytes are
   found once has no repeated window;
5. what is left by the few bytes that a window has beside those.

Every verdict of repetition is one of bytes. Digits are counted by partial
aggregation before the verdict is joined back, which adaptive execution splits
where a string is frequent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillmesh.llm.rows import keyed
from quillmesh.llm.tokens import steps
from quillmesh.llm.windows import GRAM, WIDTH, bundles
from quillmesh.workspace import regrouped, stored

#: Windows in an octet.
OCTET = 8
#: Bytes that a step holds of texts that are cut, of bundles, and of octets; each becomes some times as much on the way.
TEXT_STEP, BUNDLE_STEP, OCTET_STEP = 2 << 20, 1 << 20, 256 << 10
#: What is done with the bytes of a bundle: the first ones or all are held against those of its number; or its windows are compared.
FIRST, WHOLE, COMPARED = 0, 1, 2


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


def _scan(width: int, gram: int, seed: int):
    """One row per bundle: the row's key r, anchor hash h, digest d, the same of the next bundle, and place: 16 bits of the key, 8 of the anchor's offset, 8 of the count, 32 of the first window's place."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                found = []
                for text, r, p in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("r").to_pylist(), part.column("p").to_pylist()):
                    first, count, offset, h, d = bundles(text or b"", width, gram, seed)
                    if len(first):
                        none = np.zeros(len(first), bool)
                        none[-1] = True
                        place = first | (count << 32) | (offset << 40) | ((p - (p >> 15 << 16)) << 48)
                        found.append((np.full(len(first), r), h, d, np.roll(h, -1), np.roll(d, -1), place, none))
                if found:
                    *columns, none = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(c, mask=none if n in ("nh", "nd") else None) for n, c in zip(ROW, columns)], names=list(ROW))

    return run


ROW = ("r", "h", "d", "nh", "nd", "place")


def _cut(buffer: bytes, starts, ends) -> pa.Array:
    """The bytes of a buffer between all starts and ends."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    data = b"".join([buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _contents(width: int):
    """The bytes of wanted bundles: one row each."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", TEXT_STEP):
                for text, r, wanted in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("r").to_pylist(), part.column("wanted")):
                    rows = pa.RecordBatch.from_struct_array(wanted.values)
                    for at in range(0, len(rows), 8192):
                        some = rows.slice(at, 8192)
                        place, first_only = some.column("place").to_numpy(), some.column("what").to_numpy() == FIRST
                        start, count = place & 0xFFFFFFFF, (place >> 32) & 0xFF
                        data = _cut(text, start, start + np.where(first_only, count, count + width - 1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r)), *(some.column(c) for c in ("h", "d", "place", "c", "what")), data], names=["r", "h", "d", "place", "c", "what", "bytes"])

    return run


def repeated_range(members: list[tuple[int, int, bytes]], which: int, width: int) -> tuple[int, int] | None:
    """First and last window, from the bundle's start, that bundle ``which`` shares with another one of the same anchor.

    members: anchor's offset, number of windows and bytes. All windows of a
    bundle hold its anchor, so those shared with one other bundle are the
    windows inside what both have in common around it.
    """
    offset, count, own = members[which]
    low, high = None, None
    for j, (other_offset, _, other) in enumerate(members):
        if j == which:
            continue
        left = _common(own[:offset][::-1], other[:other_offset][::-1])
        right = _common(own[offset:], other[other_offset:])
        most, least = min(left, offset), max(width - right, offset - count + 1)
        if least <= most:
            low = offset - most if low is None else min(low, offset - most)
            high = offset - least if high is None else max(high, offset - least)
    return None if low is None else (low, high)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _compare(width: int):
    """Small groups, sorted by anchor: the repeated windows of bundles that were found once."""

    def flush(rows, out):
        members = [((r[2] >> 40) & 0xFF, (r[2] >> 32) & 0xFF, r[4]) for r in rows]
        for i, (r, _, place, c, _) in enumerate(rows):
            if c == 1 and (got := repeated_range(members, i, width)):
                out.append((r, place, *got))

    def run(batches):
        rows, out = [], []
        for batch in batches:
            for part in steps(batch, "bytes", BUNDLE_STEP):
                for row in zip(*(part.column(c).to_pylist() for c in ("r", "h", "place", "c", "bytes"))):
                    if rows and rows[-1][1] != row[1]:
                        flush(rows, out)
                        rows = []
                    rows.append(row)
                if out:
                    yield _ranges(out)
                    out = []
        flush(rows, out)
        if out:
            yield _ranges(out)

    return run


def _ranges(out):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["r", "place", "low", "high"])


def _octets(width: int):
    """Octets of bundles of large groups: ``o`` says how far before the anchor, ``low`` and ``high`` which windows of the bundle, ``bytes`` are theirs, and those that all windows at an octet's places share begin at ``core``."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "bytes", OCTET_STEP):
                rows = []
                for i, (place, data) in enumerate(zip(part.column("place").to_pylist(), part.column("bytes").to_pylist())):
                    offset, count = (place >> 40) & 0xFF, (place >> 32) & 0xFF
                    for o in range((offset - count + 1) // OCTET, offset // OCTET + 1):
                        low, high = max(0, offset - OCTET * o - OCTET + 1), min(count - 1, offset - OCTET * o)
                        rows.append((i, o, low, high, offset - low, offset - OCTET * o - low + 1, data[low : high + width]))
                if rows:
                    owner, *numbers, data = zip(*rows)
                    owner = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in ("r", "place", "c")), *(pa.array(c, pa.int64()) for c in numbers), pa.array(data, pa.binary())], names=["r", "place", "c", "o", "low", "high", "far", "core", "bytes"])

    return run


def _windows(width: int):
    """Single windows of octets whose shared bytes have the name ``nr, np``: how far before the anchor they begin, and the bytes that they have beside those."""
    core = width - OCTET + 1

    def run(batches):
        for batch in batches:
            for part in steps(batch, "bytes", OCTET_STEP):
                rows = []
                for i, (low, far, at, data) in enumerate(zip(*(part.column(n).to_pylist() for n in ("low", "far", "core", "bytes")))):
                    for s in range(len(data) - width + 1):
                        rows.append((i, low + s, far - s, data[s : at - 1] + data[at - 1 + core : s + width]))
                if rows:
                    owner, window, far, beside = zip(*rows)
                    owner = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in ("r", "place", "single", "nr", "np")), pa.array(window, pa.int64()), pa.array(far, pa.int64()), pa.array(beside, pa.binary())], names=["r", "place", "single", "nr", "np", "s", "far", "beside"])

    return run


def _large_groups(contents: DataFrame, width: int) -> DataFrame:
    """``r, place, low, high``: repeated windows of bundles that were found once, by octets and then by windows."""
    binary = lambda n: StructField(n, BinaryType())
    octets = stored(contents.mapInArrow(_octets(width), StructType([*_longs("r", "place", "c", "o", "low", "high", "far", "core"), binary("bytes")])), "octets")
    # far and the length of the bytes say which of the eight windows there are
    kinds = octets.groupBy("o", "far", "bytes").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.min(F.struct("r", "place", "low", "high", "core")).alias("one"))
    kinds = stored(kinds.select("o", "far", "bytes", "n", ((F.col("n") == 1) & (F.col("c") == 1)).alias("single"), "one.*"), "octet-kinds")
    again = kinds.where("n > 1").select(F.col("o").alias("ko"), F.col("far").alias("kf"), F.col("bytes").alias("kb"))
    whole = octets.where("c = 1").join(again, (F.col("bytes") == F.col("kb")) & (F.col("far") == F.col("kf")) & (F.col("o") == F.col("ko")), "left_semi").select("r", "place", "low", "high")
    cored = kinds.withColumn("shared", F.expr(f"substring(bytes, int(core), {width - OCTET + 1})"))
    undecided = cored.groupBy("o", "shared").agg(F.count("*").alias("k"), F.max("single").alias("any"), F.min(F.struct("r", "place")).alias("name")).where("k > 1 and any")
    undecided = undecided.select(F.col("o").alias("uo"), F.col("shared").alias("us"), F.col("name.r").alias("nr"), F.col("name.place").alias("np"))
    rest = cored.join(regrouped(undecided, "us"), (F.col("shared") == F.col("us")) & (F.col("o") == F.col("uo"))).select("r", "place", "single", "nr", "np", "low", "far", "core", "bytes")
    windows = stored(rest.mapInArrow(_windows(width), "r long, place long, single boolean, nr long, np long, s long, far long, beside binary"), "windows")
    found = windows.groupBy("nr", "np", "far", "beside").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = regrouped(found, "nr").select(*(F.col(c).alias(f"f_{c}") for c in found.columns))
    same = [F.col(c) == F.col(f"f_{c}") for c in ("nr", "np", "far", "beside")]
    single = windows.where("single").join(found, same, "left_semi")
    return whole.unionByName(single.groupBy("r", "place").agg(F.min("s").alias("low"), F.max("s").alias("high")))


def _removed(width: int):
    """Cut the repeated windows out of the texts: those of whole bundles and the others."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]

    def runs(whole, ranges):
        """Start and end of each run, ascending."""
        start = np.concatenate([whole & 0xFFFFFFFF, ranges[0]])
        end = np.concatenate([(whole & 0xFFFFFFFF) + ((whole >> 32) & 0xFF) - 1, ranges[1]]) + width
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        opens = np.concatenate([[True], start[1:] > end[:-1]])
        return start[opens], np.append(end[:-1][opens[1:]], end[-1:])

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", TEXT_STEP):
                out = []
                for text, whole, ranges in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("whole"), part.column("ranges")):
                    text = text or b""
                    whole = whole.values.to_numpy() if whole.is_valid else np.zeros(0, np.int64)
                    pair = [ranges.values.field(k).to_numpy() for k in (0, 1)] if ranges.is_valid else [np.zeros(0, np.int64)] * 2
                    if not len(whole) and not len(pair[0]):
                        out.append((len(text), 0, 0, text, []))
                        continue
                    a, b = runs(whole, pair)
                    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                    out.append((len(text), int((b - a).sum()), len(a), kept, np.stack([a, b], 1).ravel()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.list_(pa.int64()))], names=names)

    return run


def _numbered(text: DataFrame, width: int, gram: int, small: int, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Passes 1 and 2: what is wanted of each row, with the bytes of it; and whether each number stands for one string."""
    rows = text.select("r", "p", "text").mapInArrow(_scan(width, gram, seed), StructType(_longs(*ROW)))
    anchors = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("ah"))
    alive = stored(rows.join(regrouped(anchors, "ah"), F.col("h") == F.col("ah")).select(*ROW), "bundles")
    # one bundle of each number stands for all of them
    followed = (F.count("nd") == F.count("*")) & (F.min("nh") == F.max("nh")) & (F.min("nd") == F.max("nd"))
    kinds = alive.groupBy("h", "d").agg(F.count("*").alias("c"), followed.alias("followed"), F.min(F.struct("r", "place")).alias("one"))
    kinds = stored(kinds.select("h", "d", "c", "followed", "one.r", "one.place"), "kinds")
    repeated = kinds.where("c > 1").select(F.col("h").alias("kh"), F.col("d").alias("kd"), "c", F.when(F.col("followed"), FIRST).otherwise(WHOLE).cast("long").alias("what"))
    members = alive.join(repeated, (F.col("h") == F.col("kh")) & (F.col("d") == F.col("kd"))).select("r", "place", "h", "d", "c", "what")
    # groups of which some bundle was found once: single windows of it can repeat
    mixed = kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select(F.col("h").alias("mh"), F.when(F.col("k") <= small, COMPARED).otherwise(COMPARED + 1).cast("long").alias("what"))
    compared = kinds.join(regrouped(mixed, "mh"), F.col("h") == F.col("mh")).select("r", "place", "h", "d", "c", "what")
    lists = members.unionByName(compared).withColumn("p", F.shiftrightunsigned("place", 48)).groupBy(F.col("r").alias("wr"), F.col("p").alias("wp"))
    wanted = stored(lists.agg(F.collect_list(F.struct("place", "h", "d", "c", "what")).alias("wanted")), "wanted")
    schema = StructType([*_longs("r", "h", "d", "place", "c", "what"), StructField("bytes", BinaryType())])
    located = text.select("r", "p", "text").join(wanted, (F.col("r") == F.col("wr")) & (F.col("p") == F.col("wp"))).select("r", "text", "wanted")
    contents = stored(located.mapInArrow(_contents(width), schema), "contents")
    strings = contents.where(F.col("what") < COMPARED).groupBy("h", "d", "bytes").agg(F.count("*").alias("n"))
    return wanted, contents, strings.groupBy("h", "d").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, small: int = 64) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept, spans``.

    A byte goes if it is covered by a string of ``width`` bytes that also starts
    anywhere else, in the same document or another one. Strings are judged on
    the input. ``kept`` is binary, as a cut can fall inside a character;
    ``spans`` lists start and end of each removed run in turn.

    Edge cases: a null or short text stays whole; null ids are documents like
    others; rows that repeat an id are documents of their own, told apart by 80
    bits of their texts, so a repeated row repeats all its strings; an empty
    table gives no rows; other columns are not read. A very long text is scanned
    in spans, without losing a window.
    """
    id_field = StructField("id", docs.schema[id_col].dataType, True)
    text, seed = keyed(docs, id_col, text_col), 0
    wanted, contents, settled = _numbered(text, width, gram, small, seed)
    while not settled:
        seed += 1
        wanted, contents, settled = _numbered(text, width, gram, small, seed)
    ranges = contents.where(F.col("what") == COMPARED).select("r", "h", "place", "c", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_compare(width), StructType(_longs("r", "place", "low", "high")))
    large = contents.where(F.col("what") > COMPARED)
    if large.take(1):
        ranges = ranges.unionByName(_large_groups(large.select("r", "place", "c", "bytes"), width))
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    spans = ranges.groupBy(F.col("r").alias("sr"), F.shiftrightunsigned("place", 48).alias("sp")).agg(F.collect_list(F.struct((start + F.col("low")).alias("a"), (start + F.col("high")).alias("b"))).alias("ranges"))
    whole = wanted.select("wr", "wp", F.transform(F.filter("wanted", lambda x: x["what"] < COMPARED), lambda x: x["place"]).alias("whole"))
    joined = text.join(whole, (F.col("r") == F.col("wr")) & (F.col("p") == F.col("wp")), "left").join(spans, (F.col("r") == F.col("sr")) & (F.col("p") == F.col("sp")), "left").select("id", "text", "whole", "ranges")
    out = joined.mapInArrow(_removed(width), StructType([id_field, *_longs("n_bytes", "n_removed", "n_spans"), StructField("kept", BinaryType()), StructField("spans", ArrayType(LongType()))]))
    return out.withColumnRenamed("id", id_col)
