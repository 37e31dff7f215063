"""First occurrences of chunks, and what removing the others saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkflow.scratch import Table

#: Groups that rows of one hash are dealt to.
SALTS = 16


def content_hash(data: str | Column = "data") -> Column:
    return F.sha2(data, 256)


def mark_duplicates(chunks: DataFrame, key: str, scope: str = "file", order: str = "offset") -> DataFrame:
    """Adds ``hash`` if it lacks and ``is_duplicate``: an equal chunk came earlier, in the same file or anywhere.

    Files follow each other by key. Rows are written once, so what makes them runs once. Those of one hash
    are dealt to ``SALTS`` groups; each has a first place, the least of those is the hash's, and it is
    joined back to the groups, not to one heap. Chunks of whole values are marked without any shuffle by
    ``chunk_bytes(hashed=True)``.
    """
    if scope not in ("file", "global"):
        raise ValueError("scope must be file or global")
    rows = chunks if "hash" in chunks.columns else chunks.withColumn("hash", content_hash())
    names = rows.columns
    rows = Table(rows, "chunks").df
    by, salt = ([key, "hash"] if scope == "file" else ["hash"]), F.pmod(F.xxhash64(key, order), F.lit(SALTS)).cast("int")
    place = F.struct(F.col(key).alias("k"), F.col(order).alias("o"))
    rows = rows.withColumn("_salt", salt)
    groups = rows.groupBy(*by, "_salt").agg(F.min(place).alias("_least"))  # in tasks before the shuffle
    firsts = groups.withColumn("_first", F.min("_least").over(Window.partitionBy(*by))).drop("_least")  # SALTS rows at most
    joined = rows.join(firsts.select(*(F.col(c).alias(f"_{c}_of") for c in (*by, "_salt")), "_first"), [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in (*by, "_salt")], "left")
    return joined.select(*names, (place > F.col("_first")).alias("is_duplicate"))


def drop_duplicates(chunks: DataFrame, key: str, scope: str = "file", order: str = "offset") -> DataFrame:
    return mark_duplicates(chunks, key, scope, order).filter(~F.col("is_duplicate")).drop("is_duplicate")


def _shares(out: DataFrame) -> DataFrame:
    share = lambda a, b: F.round(F.coalesce(F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return out.withColumn("duplicate_percent", share("duplicate_chunks", "chunks")).withColumn("saved_percent", share("duplicate_bytes", "bytes"))


def report(marked: DataFrame, *by: str) -> DataFrame:
    """Counts and sums of chunks, and the share of duplicates by count and by bytes."""
    n, dup, size = F.count("*"), F.count_if("is_duplicate"), F.coalesce(F.sum("length"), F.lit(0))
    dup_bytes = F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.col("length"))), F.lit(0))
    return _shares(marked.groupBy(*by).agg(n.alias("chunks"), (n - dup).alias("unique_chunks"), dup.alias("duplicate_chunks"), size.alias("bytes"), dup_bytes.alias("duplicate_bytes")))


def report_by_hash(chunks: DataFrame, key: str, *by: str, order: str = "offset") -> DataFrame:
    """``report`` of what is repeated anywhere, without a row per chunk after the first shuffle.

    Chunks are counted by hash and group in their tasks. One of each hash is its first, in the group of
    its first place; all others repeat it, and equal hashes have equal lengths.
    """
    place = F.struct(F.col(key).alias("k"), F.col(order).alias("o"))
    counted = chunks.groupBy("hash", *by).agg(F.count("*").alias("n"), F.max("length").alias("each"), F.min(place).alias("least"))
    first = (F.col("least") == F.min("least").over(Window.partitionBy("hash"))).cast("long") if by else F.lit(1).cast("long")
    counted = counted.withColumn("own", first)
    dup = F.coalesce(F.sum(F.col("n") - F.col("own")), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _shares(counted.groupBy(*by).agg(zero(F.col("n")).alias("chunks"), zero(F.col("own")).alias("unique_chunks"), dup.alias("duplicate_chunks"), zero(F.col("n") * F.col("each")).alias("bytes"), zero((F.col("n") - F.col("own")) * F.col("each")).alias("duplicate_bytes")))
