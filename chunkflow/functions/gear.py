"""Content-defined cut points by a gear hash.

``h = 2 h + table[byte]`` from 0 at the start of a chunk. Its low k bits depend on the last k bytes
only, so bytes at which a cut may be made are found for a whole value at once; choosing among them is
the one sequential step, and takes a step per chunk.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from chunkflow.config import ChunkConfig


def rolling(data: np.ndarray, cfg: ChunkConfig) -> np.ndarray:
    """Low ``cfg.bits`` bits of the hash after each byte, of as many bytes as there are."""
    g = np.array(cfg.table, np.uint64)[data]
    h = g.copy()
    for j in range(1, min(cfg.bits, len(data))):
        h[j:] += g[:-j] << np.uint64(j)
    return h & np.uint64((1 << cfg.bits) - 1)


def _stateful(data: bytes, cfg: ChunkConfig) -> int:
    """Length of the first chunk, byte by byte: where windows of the hash would reach over the start."""
    end = min(len(data), cfg.greatest)
    if len(data) <= cfg.least:
        return len(data)
    strict, relaxed, h = (1 << cfg.bits) - 1, (1 << (cfg.bits - 2)) - 1, 0
    for i in range(end):
        h = (2 * h + cfg.table[data[i]]) & (1 << 64) - 1
        if i >= cfg.least and not h & (strict if i < min(cfg.average, end) else relaxed):
            return i + 1
    return end


def cut_points(data: bytes, cfg: ChunkConfig) -> list[int]:
    """Ends of the chunks of one value."""
    out: list[int] = []
    step = cfg.block or max(1, len(data))
    for base in range(0, len(data), step):
        out += [base + e for e in _block_cuts(data[base : base + step], cfg)]
    return out


def _block_cuts(data: bytes, cfg: ChunkConfig) -> list[int]:
    n, pos, ends = len(data), 0, []
    if cfg.least < cfg.bits - 1:
        while pos < n:
            pos += _stateful(data[pos:], cfg)
            ends.append(pos)
        return ends
    h = rolling(np.frombuffer(data, np.uint8), cfg)
    relaxed_at = np.flatnonzero((h & np.uint64((1 << (cfg.bits - 2)) - 1)) == 0)
    strict = relaxed_at[h[relaxed_at] == 0].tolist()
    relaxed = relaxed_at.tolist()
    while pos < n:
        end = min(n - pos, cfg.greatest)
        cut = end
        if n - pos > cfg.least:
            turn = min(cfg.average, end)
            k = bisect_left(strict, pos + cfg.least)
            if k < len(strict) and strict[k] < pos + turn:
                cut = strict[k] - pos + 1
            else:
                k = bisect_left(relaxed, pos + max(turn, cfg.least))
                if k < len(relaxed) and relaxed[k] < pos + end:
                    cut = relaxed[k] - pos + 1
        pos += cut
        ends.append(pos)
    return ends
