"""Token ids of whole texts: each distinct piece between safe white-space cuts is encoded once a worker."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from . import text as T

#: What a byte can be where texts may be cut.
_VISIBLE, _LEAD, _CUT, _LETTER, _MARK, _HIGH = (1 << k for k in range(6))
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] |= _VISIBLE
_CLASS[0xC3:0xE0] |= _LEAD
_CLASS[[0x20, 0x0A]] |= _CUT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] |= _MARK
_CLASS[0x80:] |= _HIGH


def _latin(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pieces are a space or none and letters a-z, A-Z or U+00C0 to U+00FF: one code point each, which no
    normalization changes."""
    letter = (_CLASS[data] & _LETTER) != 0
    pair = (data[:-1] == 0xC3) & ((data[1:] & 0xC0) == 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[:-1] |= pair
    letter[1:] |= pair
    size, first = np.diff(at), at[:-1]
    return T.per_doc(letter, at) == size - ((size > 1) & (data[first] == 0x20))


def _words(tokenizer):
    """A function from such pieces to what the model sees of them (None where the tokenizer's steps are not known),
    read off the tokenizer's own description."""
    steps = json.loads(tokenizer.to_str())
    lower = any(n["type"] == "Lowercase" for n in (steps["normalizer"] or {}).get("normalizers", []))
    if not lower and steps["normalizer"] is not None:
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)} | {0x0A: "\n"}

    def words(pieces: list[bytes]) -> list[str]:
        joined = b"\n".join(pieces)
        if lower:  # white space is dropped
            joined = joined.replace(b" ", b"").decode().lower().encode()
        return joined.decode("latin-1").translate(table).split("\n")

    return words


class Encoder:
    """Encodes with a tokenizers file, each distinct piece between safe cuts once.

    Both public vocabularies first split texts with a pattern that always splits where a visible character meets white
    space and where a letter meets a mark. So texts may be cut before a space or newline that follows a visible ASCII
    character or a two-byte letter, and before an ASCII mark that follows an ASCII letter; the pieces' ids on end are
    the text's. As in the library, a special token's string in a text is that token: texts are cut around it first.
    The pieces seen last are remembered, in ``most`` bytes or less.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))) or b"(?!)")
        self.words = _words(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most, self.held = most, 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for a file; it keeps what it has encoded from task to task."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, pieces: list[bytes], latin: list[bool]) -> list[bytes]:
        if self.held > self.most // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known, older, was = self.known, self.older, len(self.known)
        plain, rest = [], []
        for p, l in zip(pieces, latin):
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    (plain if l else rest).append(p)
        # a word of Latin letters is one piece of the first split, so the model alone gives its ids
        if plain:
            tokenize, kind = self.tokenizer.model.tokenize, self.dtype.char
            for p, w in zip(plain, self.words(plain)):
                known[p] = array(kind, [t.id for t in tokenize(w)]).tobytes()
        for lo in range(0, len(rest), 20_000):
            some = rest[lo : lo + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                known[p] = np.array(e.ids, self.dtype).tobytes()
        # an entry takes its slot and two small byte strings, long ones their length
        self.held += 200 * (len(known) - was) + 2 * sum(len(p) for p in rest if len(p) > 64)
        return [known[p] for p in pieces]

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (uint32) and where each text's begin."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cut, c = np.zeros(len(buf) + 1, bool), _CLASS[buf]
        cut[1:-1] = (c[1:] & _CUT) * (c[:-1] & _VISIBLE) | (c[1:] & _MARK) * ((c[:-1] & _LETTER) != 0)
        cut[2:-1] |= ((c[2:] & _CUT) * (c[:-2] & _LEAD) * (c[1:-1] >> 5 & 1)) != 0
        for m in self.special.finditer(buf):
            a, b = m.span()
            if np.searchsorted(at, a, "right") == np.searchsorted(at, b - 1, "right"):
                cut[a + 1 : b], cut[[a, b]] = False, True
        cut[at] = True
        starts = np.flatnonzero(cut)
        coded = T.pieces(buf, starts).dictionary_encode()
        data, edge = T.raw(coded.dictionary)
        latin = _latin(data, edge) if self.words is not None else np.zeros(len(edge) - 1, bool)
        joined, edge = data.tobytes(), edge.tolist()
        codes, ids = coded.indices.to_numpy(), self._ids([joined[a:b] for a, b in zip(edge, edge[1:])], latin.tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype).astype(np.uint32)
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[codes]
        end = np.cumsum(n)
        where = np.repeat(base[codes] - (end - n), n) + np.arange(end[-1])
        total = np.concatenate([[0], end])
        return flat[where], total[np.searchsorted(starts, at)]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))
