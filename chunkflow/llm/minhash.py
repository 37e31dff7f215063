"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

A sketch has ``T`` coordinates. In round i < T, every shingle is placed in the bin that hash i deals it
and bids there; in round T + j, every shingle bids for bin j, so all bins fill. Bids of earlier rounds
are less than those of later ones, the least bid of a bin is its coordinate, and a text is done after
the first round in which all of its bins are full. Coordinates of two texts agree with a probability of their similarity.

Texts with equal sets form a class, and only the least document of a class goes on. Classes that agree
in a band of coordinates meet in a bucket. A bucket does not emit its pairs: all first meet its leader,
the member whose buckets are the fullest, which in a family of copies is the text they come from. Where a
bucket still holds several components, members of different ones are compared within tasks, block against
block: sketches first, then full sets, in the first bucket that a pair shares. Only links that join
something leave a task. All links are confirmed on full sets.

Words are maximal runs of anything but space and \\t to \\r, A-Z lower-cased. A set holds the distinct
runs of ``size`` words, or the whole sequence where there are fewer. Words are known by BLAKE2b digests,
of which sets are told apart by 128 bits and a set's members by 64: two texts of 40,000 words have a
chance of 1 in 10 billion that any of their runs are taken for each other.

Defined results: null and empty texts, and those without a word, have an empty set and link with
nothing; a row without ``doc_id`` links with nothing, has a null component and is kept; rows repeated
with one id are one document, linked with whatever one of its texts links with; ties go to the least
id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm.bpe import parts
from chunkflow.llm.components import components
from chunkflow.llm.scratch import Table, bound_batches
from chunkflow.llm.words import BASE, Words, distinct, forget, mix

#: Coordinates; bands and their rows, which use all: at a similarity of 0.8 five pairs in 100 million share no band.
T, BANDS, ROWS = 128, 32, 4
#: Share of agreeing coordinates under which a candidate is not looked at: four and a half standard errors under 0.8.
LEAST_AGREEMENT = 0.64
#: Members of a block.
SIDE = 1024
#: Up to so many ids (8 bytes each) are sent to all executors; beyond, rows are shuffled to them.
BROADCAST_IDS = 1_000_000
SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, bands array<long>"


def sketches(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Coordinates of ``n`` sets given as distinct (text, value) pairs sorted by text; those of empty sets are all ones."""
    full = np.uint64(2**64 - 1)
    out = np.full(n * T, full, np.uint64)
    per = np.bincount(text, minlength=n)
    active = per > 0
    for i in range(2 * T):
        if not active.any():
            break
        if i:
            keep = active[text]
            text, value = text[keep], value[keep]
        h = mix(value + np.uint64((i * 2 + 1) * BASE % 2**64))
        bins = (h & np.uint64(T - 1)).astype(np.int64) if i < T else i - T
        bid = (h >> np.uint64(8)) | np.uint64(i << 56)
        np.minimum.at(out, text * T + bins, bid)
        active &= (out.reshape(n, T) == full).any(1)
    return out.reshape(n, T)


def signature(texts: list[str | None], size: int) -> dict[str, np.ndarray]:
    words = Words(texts, exact=True)
    text, value, other = distinct(*words.shingles(size), words.shingles(size, second=True)[1])
    del words
    n = len(texts)
    per = np.bincount(text, minlength=n)
    first = np.cumsum(per) - per
    # A sum over the set from either half of the digests: 128 bits that tell sets apart.
    sums = [np.concatenate([[0], np.cumsum(mix(v * np.uint64(BASE) + np.uint64(BASE)), dtype=np.uint64)]).astype(np.uint64) for v in (value, other)]
    s1, s2 = (s[first + per] - s[first] for s in sums)
    del other, sums
    sk = sketches(text, value, n)
    bands = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + sk[:, r : BANDS * ROWS : ROWS]) * np.uint64(BASE)
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
    return {"n": per, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "sketch": sk, "bands": bands.view(np.int64)}


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, "text"):
                s, n = signature(texts, size), len(texts)
                small = (s["sketch"] >> np.uint64(3)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s["n"]), pa.array(s["s1"]), pa.array(s["s2"]), pa.array([r.tobytes() for r in small], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(s["bands"].ravel()))],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch", "bands"],
                )
        forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted hashes of each set, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, "text"):
                text, value = distinct(*Words(texts, exact=True).shingles(size))
                at = np.searchsorted(text, np.arange(len(texts) + 1))
                sets = [value[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])
        forget()

    return docs.mapInArrow(run, "id long, set binary")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Keeps pairs (a, b, x, y) whose sketches x and y agree in enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, T) for c in "xy")
                batch = batch.filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT))
            yield batch.select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Keeps pairs (a, b, x, y) whose sets x and y have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([u, v])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left[i]`` and ``right[j]`` where ``near`` holds, 0 elsewhere."""
    out = np.zeros(near.shape, np.int64)
    p, q = np.nonzero(near)
    if len(p) <= 64:
        for i, j in zip(p, q, strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    i, j = np.unique(p), np.unique(q)
    x, y = [left[k] for k in i], [right[k] for k in j]
    vocab, col = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    both = (np.bincount(col[row < len(x)], minlength=len(vocab)) > 0) & (np.bincount(col[row >= len(x)], minlength=len(vocab)) > 0)
    place = np.cumsum(both) - 1
    used = both[col]
    row, col = row[used], place[col[used]]
    found = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, int(both.sum()), 2048):  # incidence matrices, some columns at a time
        m = np.zeros((len(x) + len(y), 2048), np.float32)
        at = (col >= c) & (col < c + 2048)
        m[row[at], col[at] - c] = 1
        found += m[: len(x)] @ m[len(x) :].T
    out[np.ix_(i, j)] = found.round().astype(np.int64)
    return np.where(near, out, 0)


def _blocks(members: DataFrame) -> DataFrame:
    """Members of open bands (band, slot, rep, c, main, n_main, n_other), once for each pair of blocks (i, j) that they are in.

    The largest component of a band and the rest of it are cut in blocks of about ``SIDE`` each, and a task has
    two blocks; two blocks of the largest component have nothing to compare and never meet.
    """
    p, q = (F.ceil(F.col(n) / SIDE).cast("int") for n in ("n_main", "n_other"))
    in_main, h = F.col("c") == F.col("main"), F.xxhash64("rep", F.lit(1))
    own = F.when(in_main, F.pmod(h, p)).otherwise(p + F.pmod(h, q)).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(in_main, p).otherwise(0), p + q - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("main", "n_main", "n_other", "other")


def _near(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, right, ok, small, large) for rows ``x`` and ``right`` of two blocks: which pairs of different components may be links.

    Their sketches agree, their sizes allow it, and they share no earlier band; those that do met there.
    """
    c, own, size = (table.column(k).to_numpy() for k in ("c", "own", "n_shingles"))
    sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, T)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    slot, i, j = (table.column(k)[0].as_py() for k in ("slot", "i", "j"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for s in range(0, len(left), 256):
        x = left[s : s + 256]
        near = np.zeros((len(x), len(right)), np.uint8)
        for t in range(T):
            near += sk[x, t][:, None] == sk[right, t][None, :]
        small, large = np.minimum(size[x][:, None], size[right]), np.maximum(size[x][:, None], size[right])
        ok = (near >= LEAST_AGREEMENT * T) & (c[x][:, None] != c[right][None, :]) & (100 * small >= percent * large)
        for t in range(slot):
            ok &= bands[x, t][:, None] != bands[right, t][None, :]
        yield x, right, ok, small, large


_PLACE = ("band", "slot", "rep", "c", "own", "i", "j", "n_shingles")


def _with_partners(spread: DataFrame, percent: int) -> DataFrame:
    """Those rows of blocks, by their ``_PLACE``, that may link with any other there; ``spread`` has sketch, bands and n_shingles."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for x, right, ok, _, _ in _near(table, percent):
            some[x] |= ok.any(1)
            some[right] |= ok.any(0)
        return table.select(_PLACE).filter(pa.array(some))

    return spread.groupBy("band", "i", "j").applyInArrow(run, "band long, slot int, rep long, c long, own int, i int, j int, n_shingles long")


def _apart(spread: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a band that were in different components; ``spread`` has sketch, bands and set too."""

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
        parent = np.arange(len(rep))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for x, right, ok, small, large in _near(table, percent):
            common = _common([sets[k] for k in x], [sets[k] for k in right], ok)
            p, q = np.nonzero(ok & (100 * common >= percent * (small + large - common)))
            for k, m in zip(x[p].tolist(), right[q].tolist(), strict=True):
                u, v = root(k), root(m)
                if u != v:
                    parent[v] = u
                    a.append(rep[k])
                    b.append(rep[m])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


class NearDuplicates:
    """``link(docs)`` gives (doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""

    def __init__(self, spark: SparkSession, size: int = 5, percent: int = 80) -> None:
        self.spark, self.size, self.percent = spark, size, percent

    def _sets(self, ids: DataFrame) -> None:
        """Adds the sets of those of ``ids`` that are not at hand."""
        for t in self.sets:
            ids = ids.join(t.df.select("id"), "id", "left_anti")
        wanted = Table(ids, "wanted")
        n = wanted.df.count()
        if n:
            small = F.broadcast(wanted.df) if n <= BROADCAST_IDS else wanted.df
            rows = self.docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small, "id", "left_semi")
            self.sets.append(Table(shingle_sets(rows, self.size), "sets"))
        wanted.drop()

    def _all_sets(self) -> DataFrame:
        sets = self.sets[0].df
        for t in self.sets[1:]:
            sets = sets.union(t.df)
        return sets

    def _confirm(self, pairs: DataFrame, reps: DataFrame) -> Table:
        """Of candidate ``pairs(a, b)``, those that are links."""
        side = lambda k, s: reps.select(F.col("rep").alias(k), F.col("sketch").alias(s), F.col("n_shingles").alias(f"n{k}"))
        seen = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        likely = Table(_agreeing(seen.select("a", "b", "x", "y")), "likely")
        self._sets(likely.df.select(F.col("a").alias("id")).union(likely.df.select("b")).distinct())
        if not self.sets:
            return likely
        sets = self._all_sets()
        of = lambda k, s: sets.select(F.col("id").alias(k), F.col("set").alias(s))
        found = Table(_similar(likely.df.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y"), self.percent).distinct(), "links")
        likely.drop()
        return found

    def link(self, docs: DataFrame) -> DataFrame:
        self.docs, self.sets = docs, []
        bound_batches(self.spark)
        sig = Table(signatures(docs, self.size), "signatures").df
        # The sketch and bands of a class are those of any member, its sets being equal.
        reps = Table(sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes").df
        members = reps.select("rep", F.posexplode("bands").alias("slot", "band")).distinct()
        # A band that very many members share is split among tasks when a join of two plain exchanges adapts:
        # what is known of each band is written before, and the hint keeps to that kind of join.
        per_band = lambda df, name: Table(df, name).df.hint("merge")
        filled = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
        bucket = Table(members.join(per_band(filled, "filled"), "band"), "buckets").df
        fame = Table(bucket.groupBy("rep").agg(F.sum("n").alias("fame")), "fame").df
        leaders = bucket.join(fame, "rep").groupBy("band").agg(F.max(F.struct("fame", F.negative("rep").alias("back"))).alias("l")).select("band", F.negative("l.back").alias("leader"))
        first = bucket.join(per_band(leaders, "leaders"), "band").filter("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
        links = self._confirm(first, reps).df
        comp = components(links)
        # Buckets of two are settled: their only pair has been compared.
        wide = bucket.filter("n > 2").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
        apart = Table(wide, "labelled").df
        per = apart.groupBy("band", "c").agg(F.count("*").alias("n"))
        open_ = per.groupBy("band").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).filter("m.n < all")
        open_ = open_.select("band", F.col("m.c").alias("main"), F.col("m.n").alias("n_main"), (F.col("all") - F.col("m.n")).alias("n_other"))
        apart = Table(apart.drop("n").join(per_band(open_, "open"), "band"), "apart").df
        # Sets are large: only members whose sketch is near another's in their block go on with them.
        sketch = reps.select("rep", "sketch", "bands", "n_shingles")
        some = Table(_with_partners(_blocks(apart.join(sketch, "rep")), self.percent), "partners").df
        self._sets(some.select(F.col("rep").alias("id")).distinct())
        if self.sets:
            # An id with several texts has a class and a set for each; the pairs of all of them are its own.
            full = some.join(sketch, ["rep", "n_shingles"]).join(self._all_sets().select(F.col("id").alias("rep"), "set"), "rep").filter("octet_length(set) = 8 * n_shingles")
            more = Table(_apart(full, self.percent), "more").df
            if not more.isEmpty():
                comp = components(links.union(more))
        by_class = reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
        by_class = Table(by_class, "by-class").df
        out = sig.select("doc_id", "n_shingles", "s1", "s2").join(by_class, ["s1", "s2"], "left")
        own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return NearDuplicates(spark, size=4, percent=80).link(docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.c = e.x),
k AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
