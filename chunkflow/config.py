"""Settings, checked when they are made."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


def default_table() -> tuple[int, ...]:
    """A value for each byte: the first 32 bits of the MD5 of its decimal digits."""
    return tuple(int(hashlib.md5(str(b).encode()).hexdigest()[:8], 16) for b in range(256))


@dataclass(frozen=True)
class ChunkConfig:
    """Least, average and greatest length of a chunk, in bytes.

    ``block``: chunks do not cross multiples of it; None for whole values. ``table``: 256 values of the
    rolling hash; the cut points of another implementation need its table.
    """

    least: int = 256 << 10
    average: int = 1 << 20
    greatest: int = 4 << 20
    block: int | None = 4 << 20
    table: tuple[int, ...] = field(default_factory=default_table)

    def __post_init__(self) -> None:
        if not (0 <= self.least <= self.average <= self.greatest and self.average >= 4):
            raise ValueError("0 <= least <= average <= greatest and average >= 4 are needed")
        if self.block is not None and self.block < 1:
            raise ValueError("a block has one byte at least")
        if len(self.table) != 256 or not all(0 <= g < 1 << 64 for g in self.table):
            raise ValueError("the table needs 256 unsigned 64-bit values")

    @property
    def bits(self) -> int:
        """Zero bits asked for before the average length; two fewer from there on."""
        return self.average.bit_length() - 1


#: For texts of kilobytes, as in the test tables.
SMALL = ChunkConfig(64, 256, 1024, None)


@dataclass(frozen=True)
class JobConfig:
    """How a job sends values: chunks, codec and its level, order of packets, and what is told of it.

    ``dry_run`` plans and runs nothing; ``log_level`` is set for the session while the job runs.
    """

    chunks: ChunkConfig = SMALL
    compression: str = "lz4"
    level: str = "default"
    uniques_first: bool = False
    dry_run: bool = False
    log_level: str | None = None

    def __post_init__(self) -> None:
        if self.compression not in ("lz4", "none"):
            raise ValueError("compression must be lz4 or none")
        if self.log_level not in (None, "DEBUG", "INFO", "WARN", "ERROR"):
            raise ValueError("log_level must be DEBUG, INFO, WARN or ERROR")
