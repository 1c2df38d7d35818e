"""Token ids of whole texts with the ``tokenizers`` library, which sees each distinct piece once.

Both tokenizers cut a text at white space before they merge, so the ids of a text are those of its pieces in
a row: the words (where white space is dropped), or each word with the white space before it. Pieces are
found and hashed (64 bits) with numpy over the column's own bytes; the ids of a piece come from the library,
from its merging alone where the piece is plain letters, and are kept with the piece's bytes in sorted arrays
by hash. Equal hashes are trusted only where the bytes are equal too. A text with a piece whose hash another
piece has, with a special token's string, or with white space beyond ASCII that the cut would miss, goes to
the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._text import Blocks, chunks, runs, spans

KEEP = 500_000
SLICE = 2 << 20
ENCODED = 4096
#: Letters that stay one piece through both tokenizers' own cutting.
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of Unicode's white space beyond ASCII, in UTF-8."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    lead = lead[lead + 2 < len(data) + 1]
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    c = data[np.minimum(lead + 2, len(data) - 1)]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[hit]


def _gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and where each begins."""
    begin = np.cumsum(size) - size
    return values[np.repeat(at - begin, size) + np.arange(int(size.sum()))], begin


class PieceTokenizer:
    """Encodes text columns to little-endian unsigned ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.marks = sorted({t.content.encode()[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.spaced = self.library.normalizer is None
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters: these stand for themselves
        self.letters = dict(zip([*signs, *(b for b in range(256) if b not in signs)], [*signs, *range(256, 512)], strict=False))
        self.clock = 0
        # kept pieces, by hash: where their ids are, how many, when last used, and their bytes
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)
        self.from_, self.bytes_, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        out: list[np.ndarray] = []
        for _, _, data, offsets in chunks(column, SLICE):
            out += self._slice(data, offsets)
        return out

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows for the library as a whole."""
        odd = np.zeros(len(offsets) - 1, bool)
        places = [np.flatnonzero((data[:-1] == m[0]) & (data[1:] == m[1])) for m in self.marks]
        if self.spaced:
            places.append(_wide_space(data))
        for p in places:
            odd[np.searchsorted(offsets, p, "right") - 1] = True
        return odd

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece."""
        starts, ends, inside = spans(data, offsets)
        mark = np.zeros(len(data) + 1, bool)
        mark[offsets] = True
        mark[ends] = True
        # a full stop or comma at a word's end, after a letter: both tokenizers cut it off
        last = ends[ends - starts > 1] - 1
        sign = last[((data[last] == 46) | (data[last] == 44)) & (_ASCII_LETTER[data[last - 1]] | ((data[np.maximum(last - 2, 0)] == 0xC3) & (last - 2 >= 0) & (data[last - 1] >= 0x80) & (data[last - 1] != 0x97) & (data[last - 1] != 0xB7)))]
        mark[sign] = True
        if not self.spaced:
            mark[starts] = True
        at = np.flatnonzero(mark[:-1])
        to = np.append(at[1:], len(data))
        if not self.spaced:
            words = inside[at]
            return at[words], to[words]
        return at, to

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        rows = len(offsets) - 1
        if not len(data):
            return [self.ids[:0]] * rows
        odd = self._odd(data, offsets)
        at, to = self._cut(data, offsets)
        if odd.any():
            keep = ~odd[np.searchsorted(offsets, at, "right") - 1]
            at, to = at[keep], to[keep]
        first = np.searchsorted(at, offsets)
        pieces = Blocks(data, at, to - at)
        keys = pieces.hashes()
        order = np.argsort(keys)
        ordered = keys[order]
        start = runs(ordered)
        distinct, sample = ordered[start], order[start]
        place, wrong = self._places(distinct, sample, data, at, to)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
        which, like = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        which[order], like[order] = place[group], sample[group]
        odd[np.searchsorted(offsets, at[pieces.unlike(like)], "right") - 1] = True
        if wrong.any():
            odd[np.searchsorted(offsets, at[order[wrong[group]]], "right") - 1] = True
        size = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[which] - ends[:-1], size) + np.arange(int(ends[-1]))]
        cuts = ends[first].tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for r in np.flatnonzero(odd).tolist():
            text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
            out[r] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        return out

    def _places(self, distinct: np.ndarray, sample: np.ndarray, data: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct piece is kept, and whether other bytes are kept there; new ones are encoded and added."""
        self.clock += 1
        if len(self.keys) > KEEP:  # keep what was used of late
            live = np.flatnonzero(self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
            live = live if len(live) < len(self.used) else live[: len(live) // 2]
            self.ids, begin = _gather(self.ids, self.at[live], self.sizes[live])
            self.text, from_ = _gather(self.text, self.from_[live], self.bytes_[live])
            self.keys, self.at, self.sizes, self.used = self.keys[live], begin, self.sizes[live], self.used[live]
            self.from_, self.bytes_ = from_, self.bytes_[live]
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        wrong = self._other_bytes(known, place, sample, data, at, to)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(at[sample[new]].tolist(), to[sample[new]].tolist(), strict=True)]
            flat, size = self._encode(pieces)
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, flat])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.at = np.concatenate([self.at, begin])[order]
            self.sizes = np.concatenate([self.sizes, size])[order]
            self.used = np.concatenate([self.used, np.full(len(new), self.clock)])[order]
            long = to[sample[new]] - at[sample[new]]
            text, from_ = _gather(data, at[sample[new]], long)
            self.from_ = np.concatenate([self.from_, from_ + len(self.text)])[order]
            self.bytes_ = np.concatenate([self.bytes_, long])[order]
            self.text = np.concatenate([self.text, text])
            place = np.searchsorted(self.keys, distinct)
        self.used[place] = self.clock
        return place, wrong

    def _other_bytes(self, known: np.ndarray, place: np.ndarray, sample: np.ndarray, data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The distinct pieces that are kept under their hash with other bytes."""
        wrong = np.zeros(len(known), bool)
        rows = np.flatnonzero(known)
        a, size = at[sample[rows]], to[sample[rows]] - at[sample[rows]]
        same = self.bytes_[place[rows]] == size
        wrong[rows[~same]] = True
        rows, a, size = rows[same], a[same], size[same]
        if len(rows):
            new, begin = _gather(data, a, size)
            old, _ = _gather(self.text, self.from_[place[rows]], size)
            wrong[rows[np.logical_or.reduceat(new != old, begin)]] = True
        return wrong

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        plain = [bool(_PLAIN(p)) for p in pieces]
        letters = [p for p, y in zip(pieces, plain, strict=True) if y]
        others = [p for p, y in zip(pieces, plain, strict=True) if not y]
        found: list[list[int]] = []
        if letters:
            mark = "\n"
            joined = mark.join(letters)
            if not self.spaced:
                joined = mark.join(self.library.normalizer.normalize_str(" ".join(letters)).split(" "))
            table = self.letters | {10: mark}
            merge = self.library.model.tokenize
            found = [[t.id for t in merge(w)] for w in joined.encode().decode("latin-1").translate(table).split(mark)]
        # some at a time: the library's own results are large
        parts = (others[k : k + ENCODED] for k in range(0, len(others), ENCODED))
        rest = (e.ids for p in parts for e in self.library.encode_batch_fast(p, add_special_tokens=False))
        plainly = iter(found)
        every = [next(plainly) if y else next(rest) for y in plain]
        return np.array([i for x in every for i in x], self.dtype), np.array([len(x) for x in every], np.int64)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per worker process and file."""
    return PieceTokenizer(path)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
