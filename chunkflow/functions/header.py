"""The 19-byte packet header in SQL functions: magic, type, offset, length and original length, little-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, SIZE = "4854", 19
DATA, REFERENCE = 1, 2


def little(value: Column, width: int) -> Column:
    """Hexadecimal digits of the bytes, least first."""
    big = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.substring(big, 2 * i - 1, 2) for i in range(width, 0, -1)))


def encode(kind: Column, offset: Column, length: Column, original: Column) -> Column:
    """BINARY header. Values beyond their field make it null."""
    fits = kind.between(0, 255) & (offset >= 0) & length.between(0, 2**32 - 1) & original.between(0, 2**32 - 1)
    return F.when(fits, F.unhex(F.concat(F.lit(MAGIC), little(kind.cast("long"), 1), little(offset.cast("long"), 8), little(length.cast("long"), 4), little(original.cast("long"), 4))))


def _number(header: Column, first: int, width: int) -> Column:
    digits = F.hex(F.substring(header, first + 1, width))
    return F.conv(F.concat(*(F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1))), 16, 10).try_cast("long")


def decode(header: Column) -> Column:
    """STRUCT<magic, type, offset, length, original_length>; null where there are not 19 bytes.

    An offset of 2^63 or more, which no signed number holds, is null.
    """
    fields = F.struct(
        F.hex(F.substring(header, 1, 2)).alias("magic"),
        _number(header, 2, 1).cast("short").alias("type"),
        _number(header, 3, 8).alias("offset"),
        _number(header, 11, 4).alias("length"),
        _number(header, 15, 4).alias("original_length"),
    )
    return F.when(F.octet_length(header) >= SIZE, fields)


def valid(decoded: Column) -> Column:
    return (decoded["magic"] == MAGIC) & decoded["type"].isin(DATA, REFERENCE) & decoded["offset"].isNotNull()


def pretty(decoded: Column) -> Column:
    kind = F.when(decoded["type"] == DATA, "data").when(decoded["type"] == REFERENCE, "reference").otherwise("unknown")
    return F.format_string("%s offset=%d length=%d original=%d", kind, decoded["offset"], decoded["length"], decoded["original_length"])
