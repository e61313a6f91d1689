"""Simple-8b: word-aligned coding of unsigned integers.

A word of 64 bits has a selector in its top 4 bits and as many values as the
selector says, of equal width, in the other 60. Ids are coded in blocks of
fixed length that start at a word of their own, so blocks decode side by side.
A value over 60 bits is escaped: the selector alone, and the value in the next
word. A coded segment, all numbers little-endian:

    4 bytes   S8B1
    u32       number of ids
    u32       ids in a block
    u32 * (blocks + 1)   offset of each block in words, and of the end
    u32       zero, where needed to reach a multiple of 8 bytes
    u64 * words
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK, ESCAPE = b"S8B1", 128, 15
#: Values in a word of selectors 1 to 14; a value has 60 // count bits. Fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_N = np.array([0, *COUNTS, 1])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; zero has none. Small values, the usual ones, are looked up."""
    if values.size and int(values.max()) < len(_SMALL):
        return _SMALL[values]
    return _bit_widths(values)


def _bit_widths(values: np.ndarray) -> np.ndarray:
    high, out = values.copy(), np.zeros(values.shape, np.uint8)
    for step in (32, 16, 8, 4, 2, 1):
        over = high >= (np.uint64(1) << np.uint64(step))
        out += (over * step).astype(np.uint8)
        high = np.where(over, high >> np.uint64(step), high)
    return out + (high > 0).astype(np.uint8)


_SMALL = _bit_widths(np.arange(1 << 16, dtype=np.uint64))


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A coded segment."""
    n = len(ids)
    rows = -(-n // block)
    values = np.zeros((rows, block + 60), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = ids
    values[:, :block] = flat.reshape(rows, block)
    ends = np.minimum(block, n - np.arange(rows) * block)
    width = _widths(values)
    # the most values that fit from each place on: the widest of the next count values decides
    selector = np.full((rows, block), ESCAPE, np.uint8)
    widest, reach = width, 1
    for s in range(14, 0, -1):
        count = COUNTS[s - 1]
        while reach < count:
            step = min(reach, count - reach)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        fits = widest[:, :block] <= 60 // count
        if not fits.any():
            break  # more values in a word leave fewer bits for wider ones
        selector[fits] = s
    at, written, made = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
    open_ = np.flatnonzero(at < ends)
    while len(open_):
        chosen = selector[open_, at[open_]]
        for s in np.unique(chosen).tolist():
            r = open_[chosen == s]
            count = int(_N[s])
            if s == ESCAPE:
                made.append((r, written[r], np.full(len(r), np.uint64(ESCAPE) << np.uint64(60))))
                made.append((r, written[r] + 1, values[r, at[r]]))
                written[r] += 2
            else:
                got = values[r[:, None], at[r][:, None] + np.arange(count)]
                word = np.bitwise_or.reduce(got << (np.arange(count) * (60 // count)).astype(np.uint64), axis=1)
                made.append((r, written[r], word | (np.uint64(s) << np.uint64(60))))
                written[r] += 1
            at[r] += count
        open_ = open_[at[open_] < ends[open_]]
    offsets = np.concatenate([[0], np.cumsum(written)])
    words = np.zeros(int(offsets[-1]), "<u8")
    for r, place, word in made:
        words[offsets[r] + place] = word
    head = MAGIC + np.array([n, block], "<u4").tobytes() + offsets.astype("<u4").tobytes()
    return head + bytes(-len(head) % 8) + words.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids of a coded segment, all blocks at once."""
    if data[:4] != MAGIC:
        raise ValueError("not a coded segment")
    n, block = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    rows = -(-n // block)
    offsets = np.frombuffer(data, "<u4", rows + 1, 12).astype(np.int64)
    start = 12 + 4 * (rows + 1)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), start + -start % 8)
    out = np.zeros((rows, block + 60), np.uint64)
    at, word_at, ends = np.zeros(rows, np.int64), offsets[:-1].copy(), np.minimum(block, n - np.arange(rows) * block)
    open_ = np.flatnonzero(at < ends)
    while len(open_):
        word = words[word_at[open_]]
        chosen = (word >> np.uint64(60)).astype(np.uint8)
        for s in np.unique(chosen).tolist():
            pick = chosen == s
            r, count = open_[pick], int(_N[s])
            if s == ESCAPE:
                out[r, at[r]] = words[word_at[r] + 1]
                word_at[r] += 1
            elif s == 0:
                raise ValueError("selector 0 is not used")
            else:
                bits = 60 // count
                out[r[:, None], at[r][:, None] + np.arange(count)] = (word[pick][:, None] >> (np.arange(count) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            at[r] += count
            word_at[r] += 1
        open_ = open_[at[open_] < ends[open_]]
    return out[:, :block].reshape(-1)[:n]
