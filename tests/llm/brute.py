"""Plain versions of the operators, in memory, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

WS = " \t\n\x0b\x0c\r"


def sha(data) -> str:
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lines(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(low)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(h := held.get(key(x), ())) >= 3 and max(h) != i)]
        out[i] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def secrets(docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = {}
    for i, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        out[i] = (*(sum(f[1] == k for f in found) for k in range(3)), sha(text))
    return out


def simhash(docs):
    import xxhash

    fps = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids, root = sorted(fps), {}
    for i in ids:  # flood from every id that has not been reached, in ascending order
        if i in root:
            continue
        root[i], stack = i, [i]
        while stack:
            a = stack.pop()
            for b in ids:
                if b not in root and (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[b] = i
                    stack.append(b)
    return {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def tokens(docs, path, end):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for i, x in docs}


def crc(ids) -> int:
    return zlib.crc32(ids.tobytes())


def mixture(docs, sources, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs}
    total = Counter()
    for i, _ in docs:
        total[sources[i]] += size[i]
    names = sorted((n for n in total if n is not None), key=lambda n: n.encode()) + [None] * (None in total)
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    left, target, free = 1.5 * sum(total.values()), {}, list(names)
    while free:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        full = [n for n in free if share[n] > 2 * total[n]]
        if not full:
            target |= share
            break
        for n in full:
            target[n] = 2 * total[n]
            left -= target[n]
        free = [n for n in free if n not in full]
    return size, total, target


def windows(docs, width=200):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + width] for _, b in data for p in range(len(b) - width + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def edits(docs):
    ordered, out = sorted(docs), {}
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        k = len(t) // 4
        out[i] = (len(t), sha(t[: len(t) - k] + after[:k]))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """The smallest id of each component of the pairs at 0.8 or more, of all pairs."""
    own, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(own, 2):
        if len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(i) for i in root}


def fingerprints(docs):
    """Canonical digests of all texts, of their edited texts, and how alike they are."""
    import unicodedata

    import regex
    import xxhash

    x64 = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    number = lambda k: x64(k.to_bytes(4, "little"))

    def canonical(t):
        nfc = lambda s: unicodedata.normalize("NFC", s)
        return regex.sub(r"[ \t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]+", " ", nfc(nfc(t).casefold())).strip(" ")

    def digest(t):
        c = canonical(t)
        part = 1
        while part * 8 <= len(c):
            part *= 2
        cuts = [c[k * part : (k + 1) * part] if k < 3 else c[3 * part :] for k in range(4)] + [c[k * (part // 2) : (k + 1) * (part // 2)] for k in range(3)]
        return [x64(c.encode()), x64(c.encode(), number(1))] + [x64(s.encode(), number(2 + k % 4)) for k, s in enumerate(cuts)]

    def like(a, b):
        if a == b:
            return 1.0
        same = lambda n, i, j: sum(a[2 + i + k] == b[2 + j + k] for k in range(n))
        return max(same(4, 0, 0), same(3, 4, 0), same(3, 0, 4)) / 4

    ordered, out = sorted(docs), {}
    own = [digest(t or "") for _, t in ordered]
    canons = Counter(canonical(t or "") for _, t in ordered)
    first = {}
    for i, t in ordered:
        first.setdefault(canonical(t or ""), i)
    hex_ = lambda d: "".join(f"{x:016x}" for x in d)
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        k = len(t) // 4
        edited = digest(t[: len(t) - k] + after[:k])
        out[i] = (hex_(own[n]), hex_(edited), like(own[n], edited), like(own[n], own[(n + 1) % len(own)]), first[canonical(t)], canons[canonical(t)])
    return out


def quality_counts(docs):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(WS)]
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
        n = len(words)
        out.append((i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n))
    return out


def spelling(docs, least=5, every=199):
    """word: (form, root, n, n_near, form_n)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, t in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = word.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    without = defaultdict(set)  # words that can be made equal by an edit share a string with at most one character less
    for w in n:
        for s in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
            without[s].add(w)

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    form, count = {}, {}
    for w in n:
        met = {v for s in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))} for v in without[s] if v != w and near(w, v)}
        count[w] = len(met)
        best = min(met, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n.get(form[w]))
    return out


def search(docs, items, most=50):
    """(item, rank, doc, score) of rows of documents and items."""
    import math

    split = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, Counter(split.findall((t or "").translate(low)))) for i, t in docs]
    size = [sum(c.values()) for _, c in held]
    n, total, df = sum(s > 0 for s in size), sum(size), Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(split.findall((t or "").translate(low)))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scores = [(-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * s * n // total))) for t in w if t in c), i is None, i or 0) for (i, c), s in zip(held, size)]
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(x for x in scores if x[0])[:most], 1)]
    return out
