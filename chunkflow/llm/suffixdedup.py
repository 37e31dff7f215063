"""Removal of repeated substrings by longest-previous-factor arrays, keeping first copies.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Each window of ``length`` bytes is named by the least hash among its substrings of ``SEED`` bytes, so
   equal windows have equal names wherever they stand. A few names cover a text.
2. Names meet by hash. Only those that occur in two documents or more can name repeated windows.
3. A maximal run of windows of one such name is a segment. A segment equal to one of a smaller document
   goes whole, so that sorting sees each content once. Segments that differ are put one after another
   and their suffixes sorted (prefix doubling, up to ``length`` bytes). The nearest suffixes of smaller
   documents before and after in that order, with their common prefixes, give each suffix its longest
   previous factor, and windows whose factor has ``length`` bytes go.
4. Removed intervals return to the texts.

Before each shuffle a task settles what it holds: of the documents with one name or one segment, only
the least asks on; the others are known to repeat it. So a passage that a third of all documents
share sends a row per task, not one per document. Its edges, windows that reach into what stands around
it, differ in each document but have its names: names so common are heavy, and their windows meet by
their own digests instead, spread over all buckets. Exact: names choose what is compared, and bytes, or
for heavy names 128 bits of a BLAKE2b digest, decide.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; a row without
``doc_id`` neither loses bytes nor takes them from others; rows with one id do not count as earlier
than each other; an empty table gives an empty result; a long text is worked on in
pieces and takes a few times its bytes, and so does a group or bucket, of 8 MB of text or so,
by its hashing and sorting half a MB at a time (a name is sorted whole); further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm.bpe import gather, parts
from chunkflow.llm.scratch import Table, bound_batches, collect_garbage, trim
from chunkflow.llm.words import BASE, mix

SEED = 20
#: Bytes hashed or sorted at a time (a longer text or name by itself), names held before a task sends them
#: on, and the bits of a text's place under its number among texts of one id.
CHUNK, HELD, PLACE = 1 << 19, 500_000, 40
#: Windows of heavy names told apart at a time.
WIDE = 1 << 18
#: Occurrences from which a name is heavy, and the share of all documents that it must reach.
HEAVY, HEAVY_SHARE = 4096, 1 / 20_000
MIX48 = np.uint64(16)
#: Bytes of text, as a power of two, for each group and bucket, and partitions that these are dealt to, for each of them.
GROUP_BITS, SPREAD = 23, 4


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64, ``n`` at least: a prefix sum then hashes any slice.

    Such hashes only propose what bytes decide.
    """
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def group_of(ids: np.ndarray, n: int) -> np.ndarray:
    """``pmod(xxhash64(id), n)`` as Spark computes it for a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(ids.view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % n


def _piece_runs(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    firsts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    power, inverse = _upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = mix((sums[SEED:] - sums[:-SEED]) * inverse[: len(data) - SEED + 1])
    width, have = length - SEED + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    text = np.repeat(np.arange(len(raw)), windows)
    at = np.arange(len(text)) + np.repeat(firsts - (np.cumsum(windows) - windows), windows)
    name = h[at]
    new = np.ones(len(text), bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return text[start], at[start] - firsts[text[start]], np.diff(np.append(start, len(text))), name[start]


def named_runs(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one name: text, place of the first window, number of windows, name; and all bytes.

    A text of more than ``CHUNK`` bytes is named piece by piece, its windows each in one of them.
    """
    pieces = [(i, s) for i, r in enumerate(raw) for s in range(0, max(1, len(r) - length + 1), CHUNK)]
    parts = [raw[i] if len(raw[i]) <= CHUNK else raw[i][s : s + CHUNK + length - 1] for i, s in pieces]
    found = []
    for a, b in _chunks(parts):
        text, at, n, name = _piece_runs(parts[a:b], length)
        found.append((np.array([i for i, _ in pieces[a:b]])[text], np.array([s for _, s in pieces[a:b]])[text] + at, n, name))
    text, at, n, name = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((),) * 4))
    new = np.ones(len(text), bool)  # a run that a cut has parted is one again
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + n[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(n, start) if len(start) else n
    return text[start], at[start], total, name[start].astype(np.uint64), np.frombuffer(b"".join(raw), np.uint8)


def _chunks(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    return _within(np.fromiter(map(len, raw), np.int64, len(raw)), CHUNK)


def _within(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that have at most ``most`` together, or one alone that has more."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _ranges(sorted_: np.ndarray) -> list[tuple[int, int]]:
    at = _runs(sorted_).tolist()
    return list(zip(at, [*at[1:], len(sorted_)][: len(at)], strict=True))


def _pack(part: np.ndarray, doc: np.ndarray, h: np.ndarray, kind: int, to: np.ndarray | None = None) -> list[tuple]:
    """Rows (to, kind, part, docs, counts, hashes), one for each part; documents are run-length coded."""
    order = np.lexsort((doc, part))
    part, doc, h = part[order], doc[order], h[order]
    rows = []
    for a, b in _ranges(part):
        d = doc[a:b]
        r = _runs(d)
        p = int(part[a])
        rows.append((p if to is None else int(to[p % len(to)]), kind, p, d[r].tobytes(), np.diff(np.append(r, len(d))).astype(np.uint32).tobytes(), _six(h[a:b])))
    return rows


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for d, c, h in zip(*(table.column(k).to_pylist() for k in ("docs", "counts", "hashes")), strict=True):
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)))
        hashes.append(_from_six(h))
    return np.concatenate(docs), np.concatenate(hashes)


NAMES = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
NAMES_SQL = "to int, kind int, part int, docs binary, counts binary, hashes binary"
#: Kinds of rows: a name of one document of a task, a name of several, a document known to have a repeated
#: name, and how often a name of several occurs (in place of documents).
ONE, SEVERAL, KNOWN, TIMES = range(4)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _trimmed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run``, after which the worker gives back what it has freed: it lives on, beside others of its executor."""

    def trimmed(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return trimmed


def _trimmed_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def trimmed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        trim()
        return out

    return trimmed


def _names(docs: DataFrame, length: int, buckets: int, groups: int) -> DataFrame:
    def send(doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        at = _runs(h)
        least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        several = least < most
        names = h[at]
        bucket = (mix(names) % np.uint64(buckets)).astype(np.int64)
        rows = [r for kind, m in ((ONE, ~several), (SEVERAL, several)) for r in _pack(bucket[m], least[m], names[m], kind)]
        times = np.diff(np.append(at, len(h)))
        rows += _pack(bucket[several], times[several], names[several], TIMES)
        held = np.repeat(several, times)
        rows += _pack(group_of(doc[held], groups), doc[held], h[held], KNOWN, np.arange(buckets))
        return _batch(rows, NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, hashes, n = [], [], 0
        for batch in batches:
            for part, texts in parts(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                text, _, _, name, _ = named_runs([t.encode() for t in texts], length)
                docs_.append(ids[text])
                hashes.append(name >> MIX48)
                n += len(name)
                if n >= HELD:
                    yield send(np.concatenate(docs_), np.concatenate(hashes))
                    docs_, hashes, n = [], [], 0
        if n:
            yield send(np.concatenate(docs_), np.concatenate(hashes))
        del docs_, hashes
        trim()

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, NAMES_SQL)


def _repeated_names(names: DataFrame, groups: int, heavy: int) -> DataFrame:
    """Which documents have which repeated names, by group of documents; names that occur ``heavy`` times as part -1."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        one = table.filter(pa.array(kind == ONE))
        doc, h = _unpack(one)
        other, g = _unpack(table.filter(pa.array(kind == SEVERAL)))
        n = len(doc)
        all_doc, all_h = np.concatenate([doc, other]), np.concatenate([h, g])
        rows = []
        if n:
            order = np.argsort(all_h, kind="stable")
            d, s = all_doc[order], all_h[order]
            at = _runs(s)
            many = (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)) | np.logical_or.reduceat(order >= n, at)
            hit = np.repeat(many, np.diff(np.append(at, len(s)))) & (order < n)
            rows = _pack(group_of(d[hit], groups), d[hit], s[hit], KNOWN)
        times, often = _unpack(table.filter(pa.array(kind == TIMES)))
        name, of = np.unique(np.concatenate([h, often]), return_inverse=True)
        many = name[np.bincount(of, np.concatenate([np.ones(n), times]), len(name)) >= heavy]
        if len(many):
            rows.append((0, KNOWN, -1, b"", b"", _six(many)))
        known = table.filter(pa.array(kind == KNOWN)).select(["part", "docs", "counts", "hashes"])
        return pa.concat_tables([known, pa.Table.from_batches([_batch(rows, NAMES).select(["part", "docs", "counts", "hashes"])])])

    return names.groupBy("to").applyInArrow(_trimmed(run), "part int, docs binary, counts binary, hashes binary")


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[start[0] : start[0] + size[0]] if len(start) == 1 else gather(data, start, size)


def _slice_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(start) == 1 and size[0] > CHUNK:
        return np.frombuffer(blake2b(data[start[0] : start[0] + size[0]], digest_size=8).digest(), np.uint64)
    own = _slices(data, start, size)
    at = np.cumsum(size) - size
    power, inverse = _upto(len(own) + 1)
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum((own.astype(np.uint64) + np.uint64(1)) * power[: len(own)], out=sums[1:])
    return mix(mix((sums[at + size] - sums[at]) * inverse[at]) + size.astype(np.uint64))


def content_classes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each slice, equal for equal bytes; hashes propose, bytes decide.

    ``CHUNK`` bytes at a time: hashing takes some forty bytes for each of them.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    chunks = list(_within(size, CHUNK))
    h = np.concatenate([_slice_hashes(data, start[a:b], size[a:b]) for a, b in chunks])
    _, first, cls = np.unique(h, return_index=True, return_inverse=True)
    like = first[cls]
    if (size[like] == size).all() and all(np.array_equal(_slices(data, start[a:b], size[a:b]), _slices(data, start[like[a:b]], size[a:b])) for a, b in chunks):
        return cls
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[a : a + n].tobytes(), len(seen)) for a, n in zip(start.tolist(), size.tolist(), strict=True)])


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, ranks) by prefix doubling: each suffix's rank by its first h bytes, for h = 8, 16 ... and last ``length``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.zeros(len(data), np.uint64)
    for j in range(8):
        rank = rank << np.uint64(8) | padded[j : j + len(data)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int32)
    out = [(8, rank)]
    while out[-1][0] < length:
        have, rank = out[-1]
        step = min(have, length - have)
        ahead = np.full(len(data), -1, np.int64)
        ahead[: len(data) - step] = rank[step:]
        out.append((have + step, np.unique(rank * np.int64(len(data) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int32)))
    return out


def _common_prefixes(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes, ``length`` at most, that the suffixes from ``a`` and ``b`` have in common: equal ranks are equal bytes."""
    out = np.where(ranks[-1][1][a] == ranks[-1][1][b], length, 0).astype(np.int32)
    open_ = np.flatnonzero(out < length)
    for h, rank in reversed(ranks[:-1]):
        fits = open_[out[open_] + h <= length]
        fits = fits[rank[a[fits] + out[fits]] == rank[b[fits] + out[fits]]]
        out[fits] += h
    for _ in range(8):  # less than the least rank's eight bytes are left
        open_ = open_[out[open_] < length]
        open_ = open_[data[a[open_] + out[open_]] == data[b[open_] + out[open_]]]
        out[open_] += 1
    return out


def _previous_smaller(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each place, the least of ``common`` on the way back to the nearest smaller ``doc``; 0 where there is none.

    ``common`` is between a place and the one before. Places that look back jump over what those they
    meet have passed already, so the way halves each round.
    """
    to, least = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero((to >= 0) & (doc[to] >= doc))
    while len(open_):
        k = to[open_]
        least[open_] = np.minimum(least[open_], least[k])
        to[open_] = to[k]
        open_ = open_[(to[open_] >= 0) & (doc[to[open_]] >= doc[open_])]
    least[to < 0] = 0
    return least


def longest_previous_factors(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Bytes, ``length`` at most, that the suffix from each of ``at`` has in common with one of a smaller document.

    Every suffix has ``length`` bytes at least. In suffix order the nearest suffixes of smaller documents
    before and after are the ones with most in common, which is the least common prefix on the way.
    """
    if not len(at):
        return np.zeros(0, np.int32)
    ranks = suffix_ranks(data, length)
    order = np.lexsort((doc, ranks[-1][1][at]))
    place, d = at[order], doc[order]
    common = np.zeros(len(at) + 1, np.int32)
    common[1:-1] = _common_prefixes(data, ranks, place[:-1], place[1:], length)
    out = np.empty(len(at), np.int32)
    out[order] = np.maximum(_previous_smaller(d, common[:-1]), _previous_smaller(d[::-1], common[:0:-1])[::-1])
    return out


def repeated_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that slices of smaller documents have too: slice, first window, number of windows, by slice.

    Equal windows have equal names, so slices of ``CHUNK`` bytes are sorted at a time, those of one name together.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    by_name = np.argsort(name, kind="stable")
    new = _runs(name[by_name])
    bounds = np.append(new, len(by_name))
    for a, b in _within(np.add.reduceat(size[by_name], new) if len(new) else new, CHUNK):
        own = by_name[bounds[a] : bounds[b]]
        n = size[own] - length + 1
        first = np.cumsum(n) - n
        slice_ = np.repeat(np.arange(len(own)), n)
        nth = np.arange(len(slice_)) - first[slice_]
        place = nth + (np.cumsum(size[own]) - size[own])[slice_]
        again = longest_previous_factors(_slices(data, start[own], size[own]), place, doc[own][slice_], length) >= length
        begins = again.copy()
        begins[1:] &= ~again[:-1] | (nth[1:] == 0)
        at = np.flatnonzero(begins)
        found.append((own[slice_[at]], nth[at], np.bincount(np.cumsum(begins)[again] - 1, minlength=len(at))))
    which, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(which, kind="stable")
    return which[order], at[order], n[order]


SEGMENTS = pa.schema([("to", pa.int32()), ("part", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("windows", pa.binary()), ("data", pa.binary())])
SEGMENTS_SQL = "to int, part int, names binary, docs binary, places binary, windows binary, data binary"


def _z(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unz(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where they touch, sorted by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    nth = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    wide = int(end.max()) + 2
    if nth[-1] and wide > 2**62 // (int(nth[-1]) + 1):  # texts of one id are numbered in the high bits
        _, high = np.unique(start >> PLACE, return_inverse=True)
        low = 1 << PLACE
        nth = np.cumsum(np.concatenate([[0], ((doc[1:] != doc[:-1]) | (high[1:] != high[:-1])).astype(np.int64)]))
        shift = start - (start & (low - 1))
        wide = int((end - shift).max()) + 2
        reach = np.maximum.accumulate(end - shift + nth * wide)
        new = np.concatenate([[True], start[1:] - shift[1:] + nth[1:] * wide > reach[:-1]])
        top = reach - nth * wide + shift
    else:
        reach = np.maximum.accumulate(end + nth * wide)
        new = np.concatenate([[True], start[1:] + nth[1:] * wide > reach[:-1]])
        top = reach - nth * wide
    at = np.flatnonzero(new)
    return doc[at], start[at], top[np.append(at[1:], len(doc)) - 1]


def _gone(part: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int = 1) -> list[tuple]:
    """Rows of removed intervals, one for each group of documents; they ask nothing, so have no names."""
    order = np.argsort(part, kind="stable")
    part, doc, start, end = part[order], doc[order], start[order], end[order]
    rows = []
    for a, b in _ranges(part):
        d, s, e = _merged(doc[a:b], start[a:b], end[a:b])
        rows.append((int(part[a]) % buckets, int(part[a]), b"", _z(d), _z(s), _z((e - s).astype(np.int64)), b""))
    return rows


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts, and the base of places in each text: 0, or its number among texts of its id in the high bits."""
    ids = table.column("doc_id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    raw = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    base = np.zeros(len(raw), np.int64)
    if len(np.unique(ids)) < len(ids):
        nth: dict[int, dict[bytes, int]] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            nth.setdefault(int(ids[i]), {})[raw[i]] = 0
        for own in nth.values():
            for k, r in enumerate(sorted(own)):
                own[r] = k
        base = np.array([nth[int(i)][r] << PLACE for i, r in zip(ids, raw, strict=True)], np.int64)
    return ids, raw, base


def _digests(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit halves of the BLAKE2b digest of each slice of ``length`` bytes."""
    raw = memoryview(data)
    return np.frombuffer(b"".join(blake2b(raw[a : a + length], digest_size=16).digest() for a in start.tolist()), np.uint64).reshape(-1, 2)


def _segments(docs: DataFrame, flags: DataFrame, length: int, buckets: int, heavy: np.ndarray) -> DataFrame:
    """Segments that ask the bucket ``to`` for earlier copies, and intervals known to go, which pass through it.

    Segments of a ``heavy`` name, the different edges of a passage that very many documents share, would
    meet in one bucket. They ask window by window, each by its digest, in the bucket of that: equal
    windows still meet, and no bucket has more than its part. Such a row says 0 windows.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flagged, names = _unpack(right)
        left = left.filter(left.column("doc_id").is_valid())
        rows: list[tuple] = []
        if len(flagged) and left.num_rows:
            known = np.sort(mix(names) + flagged.view(np.uint64) * np.uint64(BASE))
            part = right.column("part")[0].as_py()
            has = np.isin(left.column("doc_id").to_numpy(), flagged)
            ids, raw, base = _texts(left.filter(pa.array(has)))
            data = np.frombuffer(b"".join(raw), np.uint8)
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            firsts = np.cumsum(sizes) - sizes
            pieces = []
            for a, b in _chunks(raw):
                text, at, n, h, _ = named_runs(raw[a:b], length)
                text = text.astype(np.int64) + a
                d = ids[text]
                key = mix(h >> MIX48) + d.view(np.uint64) * np.uint64(BASE)
                i = np.searchsorted(known, key)
                hit = known[np.minimum(i, len(known) - 1)] == key
                text, at, n, h, d = text[hit], at[hit], n[hit], h[hit], d[hit]
                pieces.append((d, at + base[text], n, h, firsts[text] + at))
            doc, place, wins, name, start = (np.concatenate(x) for x in zip(*pieces, strict=True))
            del raw, pieces
            # Slices overlap by all but their windows, so they are looked at where they stand and copied when sent.
            size = wins + length - 1
            cls = content_classes(data, start, size)
            least = np.full(cls.max(initial=-1) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cls, doc)
            late = doc > least[cls]
            rows += _gone(np.full(int(late.sum()), part), doc[late], place[late], place[late] + size[late], buckets)
            rare = ~np.isin(name >> MIX48, heavy)
            wide = np.flatnonzero(~late & ~rare)
            wide = wide[np.argsort(name[wide], kind="stable")]  # equal windows have equal names and come together
            for a, b in _within(wins[wide], WIDE):
                own = wide[a:b]
                owner = np.repeat(own, wins[own])
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(wins[own]) - wins[own], wins[own])
                where, whose = place[owner] + nth, doc[owner]
                digest = _digests(data, start[owner] + nth, length)
                order = np.lexsort((whose, digest[:, 1], digest[:, 0]))
                where, whose, digest = where[order], whose[order], digest[order]
                new = np.concatenate([[True], (digest[1:] != digest[:-1]).any(1)])
                least_here = whose[np.flatnonzero(new)][np.cumsum(new) - 1]
                again = whose > least_here
                rows += _gone(np.full(int(again.sum()), part), whose[again], where[again], where[again] + length, buckets)
                where, whose, digest = where[~again], whose[~again], digest[~again]
                bucket = (mix(digest[:, 0]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for c, d in _ranges(bucket[order]):
                    k = order[c:d]
                    rows.append((int(bucket[k[0]]), part, _six(digest[k, 0] >> MIX48), _z(whose[k]), _z(where[k]), _z(np.zeros(len(k), np.int64)), _z(digest[k].view(np.uint8).ravel())))
            ask = np.flatnonzero(~late & rare)
            bucket = (mix(name[ask]) % np.uint64(buckets)).astype(np.int64)
            ask = ask[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket, kind="stable")
            for a, b in _ranges(bucket):
                k = ask[a:b]
                rows.append((int(bucket[a]), part, _six(name[k] >> MIX48), _z(doc[k]), _z(place[k]), _z(wins[k].astype(np.int64)), _z(gather(data, start[k], size[k]))))
        return pa.Table.from_batches([_batch(rows, SEGMENTS)])

    return docs.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_trimmed_pair(run), SEGMENTS_SQL)


def _settled(asked: DataFrame, length: int) -> DataFrame:
    """Intervals that go, from the segments of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.array([len(b) > 0 for b in table.column("names").to_pylist()], bool)
        passed = table.filter(pa.array(~asks)).select(["part", "docs", "places", "windows"])
        table = table.filter(pa.array(asks))
        if not table.num_rows:
            return passed
        cat = lambda k, t: np.frombuffer(b"".join(map(_unz, table.column(k).to_pylist())), t)
        doc, place, wins, data = cat("docs", np.int64), cat("places", np.int64), cat("windows", np.int64), cat("data", np.uint8)
        names = table.column("names").to_pylist()
        name = _from_six(b"".join(names))
        part = np.repeat(table.column("part").to_numpy(), [len(b) // 6 for b in names])
        windows_only = wins == 0  # a window by its digest, of 16 bytes
        wins = np.maximum(wins, 1)
        size = np.where(windows_only, 16, wins + length - 1)
        start = np.cumsum(size) - size
        cls = content_classes(data, start, size)
        n = int(cls.max(initial=-1)) + 1
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc)
        late = doc > least[cls]
        out = [(part[late], doc[late], place[late], place[late] + wins[late] + length - 1)]
        # Of each content, one first copy stands for it; names with one content have nothing to compare.
        first = np.flatnonzero(~late)
        rep = np.full(n, -1, np.int64)
        rep[cls[first[::-1]]] = first[::-1]
        _, of_name, per_name = np.unique(name[rep], return_inverse=True, return_counts=True)
        many = rep[(per_name[of_name] > 1) & ~windows_only[rep]] if n else rep
        if len(many):
            which, at, count = repeated_runs(data, start[many], size[many], name[many], doc[many], length)
            # All first copies of a content, also further ones in its least document.
            spot = np.full(n, -1, np.int64)
            spot[cls[many]] = np.arange(len(many))
            copies = first[spot[cls[first]] >= 0]
            s = spot[cls[copies]]
            lo = np.searchsorted(which, s, "left")
            times = np.searchsorted(which, s, "right") - lo
            k = np.repeat(copies, times)
            r = np.arange(len(k)) + np.repeat(lo - (np.cumsum(times) - times), times)
            p = place[k] + at[r]
            out.append((part[k], doc[k], p, p + count[r] - 1 + length))
        settled = pa.Table.from_batches([_batch(_gone(*(np.concatenate(x) for x in zip(*out, strict=True))), SEGMENTS)])
        return pa.concat_tables([passed, settled.select(["part", "docs", "places", "windows"])])

    return asked.groupBy("to").applyInArrow(_trimmed(run), "part int, docs binary, places binary, windows binary")


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        valid = left.column("doc_id").is_valid().to_pylist()
        ids, raw, base = _texts(left)
        cat = lambda k: np.frombuffer(b"".join(map(_unz, right.column(k).to_pylist())), np.int64)
        doc, start = cat("docs"), cat("places")
        doc, start, end = _merged(doc, start, start + cat("windows"))
        rows = []
        for i, (d, r, b, ok) in enumerate(zip(ids.tolist(), raw, base.tolist(), valid, strict=True)):
            lo, hi = (np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")) if ok else (0, 0)
            if hi > lo:
                lo, hi = lo + np.searchsorted(start[lo:hi], b), lo + np.searchsorted(start[lo:hi], b + (1 << PLACE))
            s, e = (start[lo:hi] - b).tolist(), (end[lo:hi] - b).tolist()
            kept = b"".join(r[x:y] for x, y in zip([0, *e], [*s, len(r)], strict=True))
            rows.append((d if ok else None, len(r), len(r) - len(kept), len(s), kept, [x for se in zip(s, e, strict=True) for x in se]))
        return pa.Table.from_batches([_batch(rows, out)])

    return docs.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(_trimmed_pair(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans): a row for each row of ``docs(doc_id, text)``.

    ``spans`` lists start and end of each removed run, in bytes.
    """
    if length <= SEED:
        raise ValueError(f"length must be greater than {SEED}")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # By the bytes of the texts: files may be any number of times smaller.
    n_docs, weight = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, groups = max(64, weight >> GROUP_BITS), max(128, weight >> GROUP_BITS)
    part: Column = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(groups).cast("long"))
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(groups).cast("long"))).otherwise(part)
    # More partitions than groups: hardly any task has several groups, and empty ones cost next to nothing.
    placed = docs.withColumn("part", part.cast("int")).repartition(SPREAD * groups, "part")
    # Of all names, HEAVY_SHARE bounds how many are heavy: one in 20,000 documents, some hundred names a document.
    heavy = max(HEAVY, int(n_docs * HEAVY_SHARE))
    names = _names(docs, length, buckets, groups).repartition(SPREAD * buckets, "to")
    flags = Table(_repeated_names(names, groups, heavy), "names").df
    found = [_from_six(bytes(r["hashes"])) for r in flags.filter("part = -1").select("hashes").toLocalIterator()]
    many = np.concatenate([np.zeros(0, np.uint64), *found])
    collect_garbage(spark)
    # The texts are dealt to their groups once: both cogroups read the same exchange.
    asked = _segments(placed, flags.filter("part >= 0"), length, buckets, many).repartition(SPREAD * buckets, "to")
    gone = _settled(asked, length)
    return _cut(placed, gone)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, 50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, p FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM r),
q AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
x AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM q GROUP BY doc_id, k),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM x),
z AS (SELECT y.doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(substr(h, CAST(2 * prior + 1 AS BIGINT), CAST(2 * (a - prior) AS BIGINT)), '' ORDER BY a) AS kept FROM y JOIN d USING (doc_id) GROUP BY y.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN z.doc_id IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""
