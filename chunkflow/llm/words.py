"""Words and word shingles of many texts at once, hashed to 64 bits.

Where equal hashes stand for equal words (``exact``), each distinct word is hashed once by BLAKE2b and its
digest cached: no words are made to collide, as there are for a polynomial hash whatever its base. Both
halves of a digest are at hand; what tells sets apart in all of a corpus uses both. Models and proposals
use a quicker hash by array operations.

A text is split in pieces of about ``PIECE`` bytes between words, so a long text takes some 16 bytes a
word, not a Python object for each.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes split at a time; words, and bytes of them, that the cache holds.
PIECE, CACHED, CACHED_BYTES = 1 << 18, 200_000, 4 << 20
#: Bytes of a word that are hashed by array operations.
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _table(separators: bytes) -> bytes:
    """For ``bytes.translate``: A-Z to lower case, separators to blanks."""
    return bytes(32 if c in separators else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Space and \t to \r.
BLANKS = _table(b" \t\n\v\f\r")
#: All ASCII but letters and digits.
PUNCTUATION = _table(bytes(c for c in range(128) if not chr(c).isalnum()))


class _Digests(dict):
    """Numbers of the words met; row ``number`` of ``table`` has the two halves of a word's digest."""

    def reset(self) -> None:
        self.clear()
        self.bytes = 0
        self.table = np.zeros((0, 2), np.uint64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED or self.bytes > CACHED_BYTES:
            self.reset()
        if new := list(set(words).difference(self)):
            raw = b"".join(blake2b(w, digest_size=16).digest() for w in new)
            self.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.frombuffer(raw, np.uint64).reshape(-1, 2)])
            self.bytes += sum(map(len, new))
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


@cache
def _digests() -> _Digests:
    out = _Digests()
    out.reset()
    return out


def forget() -> None:
    """Empties the cache of digests: a worker may go on with other work."""
    _digests().reset()


def _mixed(raw: bytes, stems: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words of ``raw``, whose separators are blanks: eight bytes at a time, each step mixed."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    inside = np.concatenate([[False], data[:-8] != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))  # the eight bytes from each place on
    low = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = np.zeros((len(start), 1 + len(stems)), np.uint64)
    h, some = size.astype(np.uint64) * np.uint64(BASE), np.arange(len(start))
    for k in range(0, LONG, 8):
        part = eight[start[some] + k] & low[np.minimum(size[some] - k, 8)]
        h[some] = mix(h[some] ^ part) * np.uint64(BASE)
        some = some[size[some] > k + 8]
        if not len(some):
            break
    for i in some.tolist():  # the rest of very long words
        rest = raw[start[i] + LONG : start[i] + size[i]]
        h[i] ^= np.frombuffer(blake2b(rest, digest_size=8).digest(), np.uint64)[0]
    out[:, 0] = mix(h)
    for j, n in enumerate(stems):
        long = size > n
        out[long, 1 + j] = mix((eight[start[long]] & low[n]) ^ np.uint64(n * BASE % 2**64))
    return out


class Words:
    """``hashes`` of the words of all texts in order, ``per`` text their number, ``text`` of each.

    With ``exact`` they are halves of digests, ``second`` being the other halves. Without, they are faster
    and meant for models and for proposals. ``stems`` (not with ``exact``) asks for a column each: the
    hash of so many first bytes, eight at most, and 0 for words no longer.
    """

    def __init__(self, texts: list[str | None], table: bytes = BLANKS, stems: tuple[int, ...] = (), exact: bool = False) -> None:
        rows, held, size = [], [], 0
        self.per = np.zeros(len(texts), np.int64)

        def flush() -> None:
            if exact:
                rows.append(_digests().rows(held))
            else:
                rows.append(_mixed(b" ".join(held), stems))
            held.clear()

        for i, t in enumerate(texts):
            raw = (t or "").encode().translate(table)
            at = 0
            while at < len(raw):
                end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
                piece = raw[at : end if end >= 0 else len(raw)]
                words = piece.split()
                self.per[i] += len(words)
                held += words if exact else [piece]
                size += len(piece)
                at += len(piece) + 1
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        found = np.concatenate(rows)
        self.hashes = np.ascontiguousarray(found[:, 0])
        self.second, self.stems = (np.ascontiguousarray(found[:, 1]), None) if exact else (None, found[:, 1:])
        self.text = np.repeat(np.arange(len(texts)), self.per)

    def shingles(self, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Texts and hashes of runs of ``size`` words; the whole sequence where a text has fewer."""
        h = self.second if second else self.hashes
        ends = np.cumsum(self.per)
        left = np.repeat(ends, self.per) - np.arange(len(h))  # words from here to the end of the text
        first = np.flatnonzero(left >= size)
        out = np.zeros(len(first), np.uint64)
        for j in range(size):
            out = mix(out + h[first + j]) * np.uint64(BASE)
        short = np.flatnonzero((self.per > 0) & (self.per < size))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            at = (ends - self.per)[short]
            for j in range(size - 1):
                has = j < self.per[short]
                whole[has] = mix(whole[has] + h[at[has] + j]) * np.uint64(BASE)
            whole = mix(whole + self.per[short].astype(np.uint64))
            out, text = np.concatenate([out, whole]), np.concatenate([self.text[first], short])
        else:
            text = self.text[first]
        return text, out


def distinct(text: np.ndarray, value: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct pairs, sorted by text and value; with ``other``, what goes with each."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return (text[new], value[new]) if other is None else (text[new], value[new], other[order][new])
