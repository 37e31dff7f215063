"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of pre-tokens come from no regular expression. Each code point has a class (letter,
number, white space, other; the next code points make a few more symbols of it), each symbol is a
transition function of an eight-state automaton, and the functions form a small monoid whose product
is a table look-up. Products are associative, so a blocked prefix scan over arrays gives the state at
every code point, and a look-up of (state before, symbol) says where pre-tokens start. The slices feed
pair merging with a cache; byte offsets of the tokens are kept for decoding.

Pre-tokens are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Classes are those of the installed tokenizer library, so new letters are letters as soon as it knows them.

Defined results: a null text counts as empty, and an empty text has no tokens and decodes to no bytes;
rows are independent, so repeated rows and null ids give rows of their own; a column of the input
named like an output is replaced; further columns are kept; a long text is worked on whole and takes
about 30 times its bytes. A text of over 2 GB, or of 2^31 tokens, cannot be held by a row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.llm.scratch import bound_batches

#: Code points worked on at a time (a longer text is worked on by itself); pieces, and characters in
#: them, that the cache holds; longest piece, in bytes, that is merged together with others.
CHUNK, CACHED, CACHED_CHARS, TOGETHER = 1 << 18, 200_000, 3 << 20, 128
NONE = np.int32(2**31 - 1)
#: What the transition functions split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Symbols and states of the automaton.
RESET, LETTER, NUMBER, OTHER, WHITE, SPACE_AHEAD, WHITE_AHEAD, QUOTE1, QUOTE2 = range(9)
FRESH, IN_L, IN_N, IN_O, IN_W, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a pre-token starts with it."""
    if symbol == RESET:
        return FRESH, True
    if symbol == LETTER:
        if state in (IN_L, AFTER_SPACE):
            return IN_L, False
        if state in (ONE_LEFT, TWO_LEFT):  # the letters of a contraction
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_L, True
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, AFTER_SPACE)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_O, AFTER_SPACE):
            return IN_O, False
        return {OTHER: IN_O, QUOTE1: ONE_LEFT, QUOTE2: TWO_LEFT}[symbol], True
    if symbol == WHITE:  # more white space or the end follows
        return IN_W, state != IN_W
    return (AFTER_SPACE if symbol == SPACE_AHEAD else FRESH), True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol; product table; value table [function, state]; start table [state, symbol]."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    ids: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    funcs = list(ids)
    product = np.array([[ids[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])
    return np.array([ids[g] for g in gens], np.uint8), product, np.array(funcs, np.uint8), starts


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER by code point, as the tokenizer library tells them apart.

    Its Unicode tables, not Python's, decide: every code point is sent through patterns of one class, and
    what comes back is in the class.
    """
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        library = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for a in range(0, 0x110000, 1 << 14):
            every = "".join(chr(c) for c in range(a, a + (1 << 14)) if not 0xD800 <= c < 0xE000)
            found = bytes(library.encode_ordinary(every)).decode()
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def scan_states(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """The product of all functions up to and including each place (an inclusive scan)."""
    _, product, _, _ = _monoid()
    n = len(functions)
    if n <= block:
        return np.fromiter(accumulate(functions.tolist(), lambda a, b: product[a, b]), np.uint8, n)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint8)  # 0 is the identity
    padded[:n] = functions
    cols = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat, width = product.ravel(), np.uint16(len(product))
    for j in range(1, block):
        cols[j] = flat[cols[j - 1] * width + cols[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan_states(cols[-1])[:-1]
    return np.ascontiguousarray(flat[before * width + cols].T).ravel()[:n]


def boundaries(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start; ``resets`` are the places of separators between texts."""
    gens, _, values, starts = _monoid()
    symbols = _classes()[codes]
    follows = np.zeros(len(codes), bool)  # white space, a separator or the end follows
    symbols[resets] = RESET
    blank = (symbols == WHITE) | (symbols == RESET)
    follows[:-1] = blank[1:]
    follows[-1:] = True
    ahead = (symbols == WHITE) & ~follows
    symbols[ahead] = np.where(codes[ahead] == 0x20, SPACE_AHEAD, WHITE_AHEAD)
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        symbols[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[pair]] = QUOTE2
    state = values[:, FRESH][scan_states(gens[symbols])]
    before = np.zeros(len(codes), np.uint8)
    before[1:] = state[:-1]
    return np.flatnonzero(starts[before, symbols])


def gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[first : first + length], one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - (ends - length), length)]


class PairTable:
    """Rank of each pair of adjacent tokens: an open-addressing hash table in two arrays."""

    BITS = 21

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, vals = [], []
        for w, r in ranks.items():
            for i in range(1, len(w)):
                if (a := ranks.get(w[:i])) is not None and (b := ranks.get(w[i:])) is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.vals = np.full(1 << self.BITS, NONE, np.int32)
        key, val = np.array(keys, np.int64), np.array(vals, np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.vals[at[first]] = key[first], val[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, val, at = key[rest], val[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.vals[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder(dict):
    """A cache from pre-token to its number; numbers index flat arrays of token ids."""

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        pairs = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        top = max(self.ranks.values()) + 1
        words = [b""] * top
        for w, r in self.ranks.items():
            words[r] = w
        self.bytes_of = np.frombuffer(b"".join(words), np.uint8)
        self.length_of = np.array([len(w) for w in words], np.int64)
        self.first_of = np.cumsum(self.length_of) - self.length_of
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pair = PairTable(self.ranks)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Merges pieces that the cache lacks, and caches them."""
        raw = [p.encode() for p in new]
        ids: list[np.ndarray | None] = [None] * len(raw)
        many = []
        for i, w in enumerate(raw):
            if (r := self.ranks.get(w)) is not None:
                ids[i] = np.array([r], np.int32)
            elif len(w) > TOGETHER:
                ids[i] = np.array(self.merge(w), np.int32)
            else:
                many.append(i)
        if many:
            for i, got in zip(many, self.merge_many([raw[i] for i in many]), strict=True):
                ids[i] = got
        self.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.flat = np.concatenate([self.flat, *ids])
        self.count = np.concatenate([self.count, np.fromiter(map(len, ids), np.int64, len(ids))])

    def merge_many(self, raw: list[bytes]) -> list[np.ndarray]:
        """Merges many pieces at once: each round, every piece merges its leftmost pair of lowest rank."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(raw)), sizes)
        ids = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.pair(ids[inner], ids[inner + 1])
        out: list[np.ndarray | None] = [None] * len(raw)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(ids)))
            done = low == NONE
            if done.any():
                for o, a, n in zip(owner[first[done]].tolist(), first[done].tolist(), sizes[done].tolist(), strict=True):
                    out[o] = ids[a : a + n].astype(np.int32)
                keep = np.repeat(~done, sizes)
                ids, rank, last, owner = ids[keep], rank[keep], last[keep], owner[keep]
                low, sizes = low[~done], sizes[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]  # the leftmost of each piece
            ids[at] = low
            last[at] = last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes before each later one
            ids, rank, last, owner = ids[keep], rank[keep], last[keep], owner[keep]
            rank[at] = NONE
            right = at[~last[at]]
            rank[right] = self.pair(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[~last[left]]
            rank[left] = self.pair(ids[left], ids[left + 1])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a doubly linked list and a heap keep long pieces quick."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one side has been merged since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := prior[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p in parts if p is not None]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pre-tokens of the texts, and how many each text has."""
        if len(self) > CACHED or self.chars > CACHED_CHARS:
            self.reset()
        joined = "\0".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(lengths + 1) - lengths - 1
        seps = firsts[1:] - 1
        starts = boundaries(codes, seps) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        is_sep = np.zeros(len(codes) + 1, bool)
        is_sep[seps] = True
        real = ~is_sep[starts]
        starts, ends = starts[real], ends[real]
        found = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if new := set(found).difference(self):
            self.learn(list(new))
        nums = np.fromiter(map(self.__getitem__, found), np.int64, len(starts))
        edges = np.searchsorted(starts, np.append(firsts, len(codes) + 1))
        return nums, np.diff(edges)

    def counts(self, texts: list[str]) -> np.ndarray:
        nums, per = self.pieces(texts)
        ends = np.concatenate([[0], np.cumsum(self.count[nums])])
        last = np.cumsum(per)
        return ends[last] - ends[last - per]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and how many each text has."""
        nums, per = self.pieces(texts)
        counts = self.count[nums]
        ids = gather(self.flat, (np.cumsum(self.count) - self.count)[nums], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        last = np.cumsum(per)
        return ids, ends[last] - ends[last - per]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes_of, self.first_of[ids], self.length_of[ids])


@cache
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read once on the driver; under a megabyte, it travels with the function."""
    with open(path, "rb") as f:
        return f.read()


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts, about ``CHUNK`` bytes each: a batch is never all in Python at once."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > CHUNK:
            part = batch.slice(first, i - first)
            yield part, part.column(text).to_pylist()
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        part = batch.slice(first)
        yield part, part.column(text).to_pylist()


def _with_columns(batch: pa.RecordBatch, cols: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in batch.schema.names if n not in cols}
    return pa.RecordBatch.from_pydict(kept | cols)


def _map(df: DataFrame, fn: Callable, fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    new = {f.name for f in fields}
    schema = T.StructType([f for f in df.schema.fields if f.name not in new and f.name not in drop] + fields)
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def encode(df: DataFrame, path: str, text: str = "text", keep_text: bool = True, decoded: bool = False) -> DataFrame:
    """Adds ``token_ids array<int>`` and ``token_starts array<int>``, the byte offset of each token.

    With ``decoded`` also what ``decode`` adds, in the same pass: one Python process a task, not two.
    """
    vocab = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for part, texts in parts(batch, text):
                ids, per = enc.encode([t or "" for t in texts])
                ends = np.cumsum(enc.length_of[ids])
                offsets = np.concatenate([[0], np.cumsum(per)])
                base = np.concatenate([[0], ends])[offsets[:-1]]
                starts = ends - enc.length_of[ids] - np.repeat(base, per)
                at = pa.array(offsets.astype(np.int32))
                cols = {"token_ids": pa.ListArray.from_arrays(at, pa.array(ids)), "token_starts": pa.ListArray.from_arrays(at, pa.array(starts.astype(np.int32)))}
                if decoded:
                    cols["decoded"] = _decoded(enc, cols["token_ids"], cols["token_starts"])
                yield _with_columns(part if keep_text else part.drop_columns([text]), cols)
        enc.reset()  # the worker may go on with other work

    out = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("token_starts", T.ArrayType(T.IntegerType(), True))]
    return _map(df, run, out + [T.StructField("decoded", T.BinaryType())] * decoded, () if keep_text else (text,))


def _decoded(enc: Encoder, ids: pa.ListArray, starts: pa.ListArray) -> pa.Array:
    """Each token's bytes at its offset; an error where the offsets are not those of the tokens."""
    values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    per = np.asarray(ids.value_lengths().fill_null(0), np.int64)
    at = starts.flatten().to_numpy(zero_copy_only=False)
    data = enc.decode(values)
    ends = np.concatenate([[0], np.cumsum(enc.length_of[values])])[np.cumsum(per)]
    edges = np.concatenate([[0], ends])
    if not np.array_equal(at + np.repeat(edges[:-1], per), np.cumsum(enc.length_of[values]) - enc.length_of[values]):
        raise ValueError("token offsets do not fit the token ids")
    out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
    return pc.if_else(ids.is_valid(), out, None) if ids.null_count else out


def decode(df: DataFrame, path: str, ids: str = "token_ids", starts: str = "token_starts") -> DataFrame:
    """Adds ``decoded binary``: each token's bytes at its offset. A null list decodes to null."""
    vocab = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield _with_columns(part, {"decoded": _decoded(enc, part.column(ids), part.column(starts))})

    return _map(df, run, [T.StructField("decoded", T.BinaryType())])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the vocabulary's pattern is not the one that the transition functions are made for")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path, keep_text=False, decoded=True)
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
