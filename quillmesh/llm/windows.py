"""Repeated windows of bytes: the arithmetic inside a task.

A window is ``width`` bytes from any place. Among the places inside it where a
gram of ``gram`` bytes begins, the one with the smallest hash is its anchor,
and ties go to the leftmost; what a window's anchor is depends on the window's
bytes alone, so equal windows have equal anchors at equal places. Neighbouring
windows mostly share their anchor: a run of windows with one anchor is a bundle.
"""

from __future__ import annotations

import numpy as np

WIDTH, GRAM = 200, 40
#: Bytes of text whose windows are found at once; bounds the arrays.
SPAN = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place, by doubling: h(2n) = h(n) * base**n + h(n) later."""
    power = 1 << (gram.bit_length() - 1)
    h, n, b = data.astype(np.uint64) + np.uint64(1), 1, base
    total, total_n = None, 0
    with np.errstate(over="ignore"):
        while n <= power:
            if gram & n:
                total = h if total is None else h[: len(h) - total_n] * np.uint64(pow(base, total_n, 1 << 64)) + total[n:][: len(h) - total_n]
                total_n += n
            if n < power:
                h = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:]
            n *= 2
        return _mixed(total[: len(data) - gram + 1])


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of the ``n`` values from each place."""
    reach = 1
    while reach < n:
        step = min(reach, n - reach)
        x = np.minimum(x[:-step], x[step:])
        reach += step
    return x


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``data``: the place of its anchor, and the hash of each gram."""
    h = gram_hashes(data, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    return (_window_min(key, width - gram + 1) & _PLACE).astype(np.int64), h


def bundles(text: bytes, width: int = WIDTH, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, count, anchor_offset, anchor_hash, digest`` of the bundles of a text: its windows, cut where the anchor changes.

    The digest is of all bytes of the bundle's windows and of where the anchor
    is among them; ``seed`` draws other digests. Long texts are taken in spans; a
    bundle ends there as well.
    """
    from xxhash import xxh3_64_intdigest

    if not gram <= width or width - gram >= 255:
        raise ValueError("a bundle's number of windows and an anchor's offset have to fit into a byte")
    n = len(text) - width + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    data, out = np.frombuffer(text, np.uint8), []
    for at in range(0, n, SPAN):
        anchor, h = anchors(data[at : at + SPAN + width - 1], width, gram)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        place = anchor[first]
        digest = np.array([xxh3_64_intdigest(text[at + a : at + a + c + width - 1], d + (seed << 8)) for a, c, d in zip(first.tolist(), count.tolist(), (place - first).tolist())], np.uint64)
        out.append((first + at, count, place - first, h[place].view(np.int64), digest.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))
