"""Token ids of whole texts by a public tokenizer, with tables of words and pieces.

A byte-pair model merges within the pieces that its pre-tokenizer makes and
never across them, and no piece reaches over ASCII white space but for one
leading space. So a text is cut into words there and a worker encodes each
distinct word once; texts then become look-ups and array gathers. Words of
common Latin characters are cut into the pieces here and new pieces given to
the tokenizer's model; a word with any other character, and a text in which
words could affect each other, go through the whole tokenizer. All ways give
the tokenizer's own ids. A tokenizer that isn't built from the parts that this
relies on encodes every text as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, and distinct pieces, that a worker remembers; bounds its memory.
CACHED_WORDS = 300_000
#: Bytes of text that a task takes at once; bounds the arrays of one step.
STEP_BYTES = 8 << 20
#: The same for encoding, which has some forty bytes of arrays for each byte of text.
ENCODED_BYTES = 4 << 20

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
#: Any character about whose class libraries could disagree, and the start of an added token.
_OTHER = re.compile(rf"<\||[^\t-\r\x20-~{_LETTER}¡§«»¿–—‘’“”…€]")
#: The same for ASCII text.
_OTHER_ASCII = re.compile(r"<\||[\x00-\x08\x0e-\x1f\x7f]")
#: Stands between words whose pieces are cut in one go; _OTHER keeps it out of them.
_MARK = "\x02"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pieces of the two kinds of pre-tokenizer, for words without _OTHER.
_SPACED = re.compile(rf"{_MARK}|{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_MARK}{_LETTER}0-9]+|\s+(?!\S)|\s+")
_BARE = re.compile(rf"{_MARK}|{_ENDINGS}|[{_LETTER}]+|[0-9]|[^\s{_MARK}{_LETTER}0-9]+")
_SPACED_ASCII = re.compile(rf"{_MARK}|{_ENDINGS}| ?[A-Za-z]+| ?[0-9]+| ?[^\s{_MARK}A-Za-z0-9]+|\s+(?!\S)|\s+")
_BARE_ASCII = re.compile(rf"{_MARK}|{_ENDINGS}|[a-z]+|[0-9]|[^\s{_MARK}a-z0-9]+")
#: Words with one leading space, and what else there is of white space.
_WORDS = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: White space other than ASCII's, separators that some count as such, and added tokens: here words can affect each other.
_JOINED = "<\\||[\x1c-\x1f\u0085  ᠎ -​    ⁠　﻿]"
#: White space that isn't one space or newline between two words.
_UNEVEN = "^[\x00-\x20]|[\x00-\x20]$|  |\n\n| \n|\n |[\x00-\x09\x0b-\x1f]"


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: How the model sees pieces that are joined by _MARK.
_SHOWN = {b: c for b, c in _byte_characters().items() if b != ord(c)} | {ord(_MARK): " "}
_encoders: dict = {}

#: The parts of the two kinds of tokenizer whose words can be encoded apart.
_LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BARE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(tokenizer) -> str | None:
    """``spaced``: byte-level with white space kept; ``bare``: lower case with white space dropped; None for any other."""
    spec = json.loads(tokenizer.to_str())
    model, before, normal = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"]
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
    added = all(t["content"].startswith("<|") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    if model["type"] != "BPE" or any(odd) or not added or spec["truncation"] or spec["padding"]:
        return None
    level = lambda p, regex: p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex") == regex
    if normal is None and level(before, True):
        return "spaced"
    if normal and normal.get("normalizers") == _LOWERS and len(parts := before.get("pretokenizers", [])) == 2:
        split = parts[0]
        if split["type"] == "Split" and split["pattern"] == {"Regex": _BARE_PIECES} and split["behavior"] == "Removed" and split["invert"] and level(parts[1], False):
            return "bare"
    return None


class _Table(dict):
    """Key to its number, with the ids of each number; notes the keys that it had not seen."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.starts, self.lengths, self.flat, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def numbers(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the fresh keys."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(lengths), np.int32)])
        self.fresh = []

    def note(self, which: np.ndarray) -> None:
        """Count one step for each of the numbers."""
        here = np.zeros(len(self.seen), bool)
        here[which] = True
        self.seen += here

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``which`` in a row, and how many belong to each."""
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.starts[which] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        return self.flat[at], lengths

    def forget(self, most: int) -> "_Table":
        """A table of the keys that more than one step has had, the most frequent ones, ``most`` at most."""
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > most:
            kept = kept[np.argsort(-self.seen[kept], kind="stable")[:most]]
        out, keys = _Table(), list(self)
        for n in kept.tolist():
            out[keys[n]]
        ids, lengths = self.ids(kept)
        out.add(lengths, ids)
        out.seen += 1
        return out


class Encoder:
    """Encodes texts with ``path``, a file of the tokenizers library."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.cached_words = cached_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(self.tokenizer)
        self.words, self.pieces = _Table(), _Table()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the whole tokenizer."""
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

    def _piece_ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many belong to each."""
        if len(self.pieces) > self.cached_words:
            self.pieces = self.pieces.forget(self.cached_words // 2)
        table = self.pieces
        which = table.numbers(found)
        if table.fresh:
            real = np.array([p != _MARK for p in table.fresh])
            # one character for each byte, and spaces between the pieces
            shown = _MARK.join([p for p in table.fresh if p != _MARK])
            shown = (shown if shown.isascii() else shown.encode().decode("latin-1")).translate(_SHOWN)
            tokenize, ids, counts = self.tokenizer.model.tokenize, [], []
            for piece in shown.split(" ") if shown else ():
                got = tokenize(piece)
                ids += [t.id for t in got]
                counts.append(len(got))
            lengths = np.zeros(len(real), np.int64)
            lengths[real] = counts
            table.add(lengths, np.array(ids, np.int32))
        table.note(which)
        return table.ids(which)

    def _plain(self, raw: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without _OTHER, given with a space between them; a tab marks a word at a text's start, which has no space before it."""
        if self.kind == "bare":
            text = (_MARK + raw.replace(" ", _MARK)).lower()
            found = (_BARE_ASCII if text.isascii() else _BARE).findall(text)
        else:
            text = (f"{_MARK} " + raw.replace(" ", f"{_MARK} ")).replace(f"{_MARK} \n", f"{_MARK}\n").replace(f"{_MARK} \t", _MARK)
            found = (_SPACED_ASCII if text.isascii() else _SPACED).findall(text)
        ids, lengths = self._piece_ids(found)
        starts = np.flatnonzero(np.fromiter((p == _MARK for p in found), bool, len(found)))
        return ids, np.add.reduceat(lengths, starts)

    def _fresh(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, as _cut makes them."""
        raw = [w for w in words if isinstance(w, bytes)]
        joined = b" ".join(raw).decode()
        other = _OTHER_ASCII if joined.isascii() else _OTHER
        if len(raw) == len(words) and not other.search(joined):
            return self._plain(joined)
        shown = iter(joined.split(" "))
        shown = [next(shown) if isinstance(w, bytes) else w for w in words]
        plain = [isinstance(w, bytes) and not other.search(s) for w, s in zip(words, shown)]
        first, second = [s for s, p in zip(shown, plain) if p], [s for s, p in zip(shown, plain) if not p]
        text_of = lambda w, s: s if self.kind == "bare" or not isinstance(w, bytes) else s if s[0] == "\n" else s[1:] if s[0] == "\t" else " " + s
        second = [text_of(w, s) for w, s, p in zip(words, shown, plain) if not p]
        parts = [self._plain(" ".join(first)) if first else (np.zeros(0, np.int32), np.zeros(0, np.int64)), self._whole(second)]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~np.array(plain))])
        both = _Table()
        both.add(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts]))
        return both.ids(np.argsort(order))

    def _numbered(self, words: pa.Array) -> np.ndarray:
        """Numbers of words; equal words are looked up once."""
        coded = words.dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        keys = pc.binary_join(one, b" ")[0].as_py().split(b" ")  # faster than value by value
        return self.words.numbers(keys)[coded.indices.to_numpy()]

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of the words of each text. Bytes: a word, after a newline with that before it, at a text's start with a tab. Str: a word of uneven white space, as it is."""
        if self.kind == "bare":
            lists = pc.ascii_split_whitespace(texts)
            return np.split(self._numbered(lists.flatten().cast(pa.binary())), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()) if len(texts) else []
        whole = pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False)
        even = ~whole & ~pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        rows = np.flatnonzero(even)
        if len(rows):
            marked = pc.replace_substring(pc.binary_join_element_wise("\t", texts.take(pa.array(rows)), ""), "\n", " \n")
            lists = pc.split_pattern(marked, " ")
            for i, got in zip(rows.tolist(), np.split(self._numbered(lists.flatten().cast(pa.binary())), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())):
                out[i] = got
        for i in np.flatnonzero(~even).tolist():
            text = texts[i].as_py()
            out[i] = self.words.numbers([text] if whole[i] else _WORDS.findall(text))
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, a list or an array of strings, in a row, and how many belong to each."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if self.kind is None:
            return self._whole(texts.to_pylist())
        if len(self.words) > self.cached_words or len(self.words.flat) > 16 * self.cached_words:
            self.words = self.words.forget(self.cached_words // 2)
        got = self._cut(texts)
        if self.words.fresh:
            ids, lengths = self._fresh(self.words.fresh)
            self.words.add(lengths, ids)
        which = np.concatenate(got) if got else np.zeros(0, np.int64)
        self.words.note(which)
        ids, lengths = self.words.ids(which)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, got)])]
        return ids, np.diff(ends)


def encoder(path: str, cached_words: int = CACHED_WORDS) -> Encoder:
    """This worker's encoder of ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cached_words = cached_words
    return _encoders[path]


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES):
    """Slices of a batch of about ``most`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encoded(batches, path: str, end_id: int, text: str = "text", cached_words: int = CACHED_WORDS):
    """For each step of the batches: the slice, all ids as uint32 with the end id after each text, and the numbers of ids."""
    enc = encoder(path, cached_words)
    for batch in batches:
        for part in steps(batch, text, ENCODED_BYTES):
            ids, counts = enc.encode(part.column(text))
            counts = counts + 1
            out = np.full(int(counts.sum()), end_id, np.uint32)
            mask = np.ones(len(out), bool)
            mask[np.cumsum(counts) - 1] = False
            out[mask] = ids
            yield part, out, counts
