"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label are dealt to overlapping shards, those of their nearest centroids. Each shard
links every vector to near ones that robust pruning leaves; the adjacency lists of all shards are
united. A search enters a shard at its medoid, at the medoid of each component that pruning left and at
the query's own node, follows the united lists greedily with a beam, and goes on from everything within
range until nothing new is near enough. Where it meets a node in range that other shards hold too, it
goes on there in the next round, entering by that node: a query visits shards for as long as its range
reaches new ones, and at least those of the ``PROBES`` next centroids. So the united graph is searched
as one, while a task holds one shard and the queries that visit it. What is found is verified in double
precision. A query set (all ids divisible by 20, and all ids of a label with few of those) is compared with
all rows by brute force, block by block.
The vectors of a label whose recall so measured is short of ``LEAST_RECALL`` are dealt to twice as many shards;
where those would be all shards of the label, all its pairs are compared in blocks instead.

Equal vectors of a label stand for one node, so a heap of copies costs no more than one vector. Links
are counted where they are found, the first time a query meets a node, and only a spanning star of each
shard's components leaves it. A shard of more than ``MOST`` vectors is dealt again, by centroids that
its task fits to a sample of it, so shards do not grow with the table.

Defined results: a null label, and a vector that is null, zero, empty or holds null or non-finite
components, links with nothing; vectors of different length do not link; a row without id links with
nothing, has a null component and is kept; rows repeated with the same id, label and vector count
once; ties go to the least id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm.bpe import gather
from chunkflow.llm.components import components
from chunkflow.llm.scratch import Table, sampled
from chunkflow.llm.words import mix

#: Vectors aimed at in a shard before overlap; shards a vector is dealt to; candidates and degree of the
#: graph; slack of pruning; width of the beam; slack under the threshold within which a search goes on.
SHARD, OVERLAP, CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 500, 2, 48, 20, 1.2, 24, 0.04
LEAST_RECALL = 0.99
#: Labels with fewer queries are asked whole.
LEAST_ASKED = 20
#: Vectors of a block where all pairs are compared.
SIDE = 2048
#: Centroids beyond its shards' that a query visits anyway; vectors of a shard that is dealt again, and of
#: the sample that its centroids are fit to; visitors of a task.
PROBES, MOST, SHARD_SAMPLE, VISITORS = 4, 4000, 8192, 4096
FOUND = "space string, id long, n long, to long"
#: Of a query also the shards to visit next, and the node by which it enters each.
SEARCHED = FOUND + ", next array<long>, enter array<long>"
#: Pairs whose vectors are held side by side.
PAIRS = 1 << 16
#: Bounds on what the driver fits centroids with: centroids and vectors of the sample.
MOST_CENTROIDS, MOST_SAMPLE = 16_384, 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    x = _unit(x)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        norm = np.sqrt((sums * sums).sum(1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def build(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours of each unit vector: rows of indices, -1 where there are fewer."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if k < 1:
        return out
    for a in range(0, n, 256):
        sims = x[a : a + 256] @ x.T
        m = len(sims)
        sims[np.arange(m), np.arange(a, a + m)] = -np.inf
        cand = np.argpartition(-sims, k - 1, 1)[:, :k]
        near = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-near, 1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        v = x[cand]
        among = 1 - np.einsum("nid,njd->nij", v, v, optimize=True)
        far, alive = 1 - near, np.ones((m, k), bool)
        for r in range(DEGREE):
            pick = np.argmax(alive, 1)
            has = alive[np.arange(m), pick]
            if not has.any():
                break
            out[np.arange(a, a + m)[has], r] = cand[has, pick[has]]
            alive &= ~((ALPHA * among[np.arange(m), pick] <= far) & has[:, None])
            alive[np.arange(m), pick] = False
    return out


def entries(x: np.ndarray, first: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The medoid of the graph and those of its components; edges go both ways."""
    label, row = np.arange(len(x)), np.repeat(np.arange(len(x)), np.diff(first))
    while True:
        least = label.copy()
        np.minimum.at(least, row, label[near])
        least = least[least]
        if (least == label).all():
            break
        label = least
    roots, own = np.unique(label, return_inverse=True)
    sums = np.zeros((len(roots), x.shape[1]), x.dtype)
    np.add.at(sums, own, x)
    order = np.lexsort((-np.einsum("ij,ij->i", x, sums[own]), own))
    medoids = order[np.searchsorted(own[order], np.arange(len(roots)))]
    return np.unique(np.append(medoids, np.argmax(x @ x.mean(0))))


def search(x: np.ndarray, first: np.ndarray, near: np.ndarray, starts: np.ndarray, xq: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Similarity of each query to every node its search met; -2 for the others.

    The neighbours of node i are ``near[first[i] : first[i + 1]]``; searches enter from ``starts`` and
    their ``own`` node, where that is not -1.
    """
    n, q = len(x), len(xq)
    sims = np.full(q * n, -2, np.float32)
    done = np.zeros(q * n, bool)
    code = np.unique(np.append((np.arange(q)[:, None] * n + starts).ravel(), (np.arange(q) * n + own)[own >= 0]))
    for k in range(0, len(code), PAIRS):
        r, v = np.divmod(code[k : k + PAIRS], n)
        sims[code[k : k + PAIRS]] = np.einsum("ij,ij->i", xq[r], x[v])
    beam = min(BEAM, n)
    while len(code):
        done[code] = True
        row, node = np.divmod(code, n)
        per = first[node + 1] - first[node]
        total = np.cumsum(per)
        edges = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)), [len(code)]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # so many pairs of query and neighbour at a time
            new = np.repeat(row[lo:hi] * n, per[lo:hi]) + gather(near, first[node[lo:hi]], per[lo:hi])
            new = np.unique(new[sims[new] == -2])
            for k in range(0, len(new), PAIRS):
                r, v = np.divmod(new[k : k + PAIRS], n)
                sims[new[k : k + PAIRS]] = np.einsum("ij,ij->i", xq[r], x[v])
        grid = sims.reshape(q, n)
        floor = np.minimum(np.partition(grid, n - beam, 1)[:, n - beam], least - SLACK)
        code = np.flatnonzero((grid >= np.maximum(floor, -1.5)[:, None]).ravel() & ~done)
    return sims.reshape(q, n)


def _vectors(table: pa.Table, name: str = "v") -> np.ndarray:
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and how many each row has."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.value_lengths().fill_null(0), np.int64)


def _padded(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Lists as rows of a matrix, -1 where they are shorter."""
    out = np.full((len(per), max(1, int(per.max(initial=0)))), -1, np.int64)
    row = np.repeat(np.arange(len(per)), per)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(per) - per, per)] = values
    return out


def _array(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of ``values`` by ``rows``, which are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _adjacency(dealt: DataFrame) -> DataFrame:
    """(shard, id, near): neighbours of each vector in each of its shards."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        graph = build(_unit(_vectors(table)[order]).astype(np.float32))
        row, slot = np.nonzero(graph >= 0)
        return pa.table({"id": pa.array(ids), "near": _array(row, ids[graph[row, slot]], len(ids))})

    return dealt.select("shard", "id", "v").groupBy("shard").applyInArrow(run, "id long, near array<long>")


class Shard:
    """A shard's vectors, the shards that hold each, the part of the united graph among them, and where to enter."""

    def __init__(self, table: pa.Table) -> None:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy())))
        self.ids, self.times, self.raw = table.column("id").to_numpy(), table.column("times").to_numpy(), _vectors(table)
        self.shards = _padded(*_lists(table, "shards"))
        n = len(self.ids)
        flat, per = _lists(table, "near")
        row, at = np.repeat(np.arange(n), per), np.searchsorted(self.ids, flat)
        here = (at < n) & (self.ids[np.minimum(at, n - 1)] == flat)
        a, b = row[here], at[here]
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))  # an edge is walked both ways
        a, self.near = np.divmod(pairs, n)
        self.first = np.searchsorted(a, np.arange(n + 1))
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.x = (self.raw / self.norm[:, None]).astype(np.float32)
        self.enter = entries(self.x, self.first, self.near)

    def met(self, raw: np.ndarray, own: np.ndarray, least: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of query and node that are linked, and pairs in range with their similarity."""
        norm = np.sqrt((raw * raw).sum(1))
        sims = search(self.x, self.first, self.near, self.enter, (raw / norm[:, None]).astype(np.float32), own, least)
        q, j = np.nonzero(sims >= least - SLACK)
        near = sims[q, j]
        maybe, ok = np.flatnonzero(near >= least - 1e-3), []
        for k in range(0, len(maybe), PAIRS):
            m = maybe[k : k + PAIRS]
            ok.append(m[np.einsum("ij,ij->i", raw[q[m]], self.raw[j[m]]) / (norm[q[m]] * self.norm[j[m]]) >= least])
        ok = np.concatenate(ok) if ok else maybe
        return (q[ok], j[ok]), (q, j, near)

    def beyond(self, q: np.ndarray, j: np.ndarray, near: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, shard, node): shards that hold a node in range and are not ``known`` to the query, and the nearest such node.

        ``known`` has a row of shards for each query.
        """
        slot = self.shards[j]
        ok = slot >= 0
        for k in range(known.shape[1]):
            ok &= slot != known[q, k][:, None]
        at, k = np.nonzero(ok)
        order = np.lexsort((-near[at], slot[at, k], q[at]))
        at, k = at[order], k[order]
        query, shard = q[at], slot[at, k]
        new = np.ones(len(at), bool)
        new[1:] = (query[1:] != query[:-1]) | (shard[1:] != shard[:-1])
        return query[new], shard[new], self.ids[j[at[new]]]


def _links(rows: DataFrame, least: float) -> DataFrame:
    """Every vector searched in its own shards: links counted, the least node of its component there, where to go on."""

    def run(table: pa.Table) -> pa.Table:
        own, space = table.column("shard")[0].as_py(), table.column("space")
        s = Shard(table)
        n = len(s.ids)
        # Shards before this one that a vector is also in: a link found there is counted there.
        prior = np.where((s.shards >= 0) & (s.shards < own), s.shards, -1)
        bits = np.zeros((n, -(-n // 8)), np.uint8)  # n is MOST at most but for vectors that nothing tells apart
        onward = []
        for a in range(0, n, 256):
            q = np.arange(a, min(n, a + 256))
            (i, j), reached = s.met(s.raw[q], q, least)
            hit = np.zeros((len(q), n), bool)
            hit[i, j] = True
            hit[np.arange(len(q)), q] = False
            bits[q] = np.packbits(hit, axis=1)
            query, shard, node = s.beyond(*reached, s.shards[q])
            onward.append((q[query], shard, node))
        count, label = np.zeros(n, np.int64), np.arange(n)
        linked = []
        for a in range(0, n, 256):
            q = np.arange(a, min(n, a + 256))
            back = np.unpackbits(bits[:, a // 8 : -(-(a + len(q)) // 8)], axis=1)[:, : len(q)].T.astype(bool)
            hit = np.unpackbits(bits[q], axis=1, count=n).astype(bool) | back
            bits[q] = np.packbits(hit, axis=1)  # now both ways
            i, j = np.nonzero(hit)
            if len(i):
                seen = np.zeros(len(i), bool)
                for k in range(prior.shape[1]):
                    for m in range(prior.shape[1]):
                        seen |= (prior[q[i], k] == prior[j, m]) & (prior[q[i], k] >= 0)
                count[q] += np.bincount(i[~seen], s.times[j[~seen]], len(q)).astype(np.int64)
                linked.append(q[np.unique(i)])
        for start in np.concatenate(linked) if linked else []:
            if label[start] == start:  # spread its number, the least of what it reaches, unless reached before
                front = np.array([start])
                while len(front):
                    reach = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[front], 0), count=n))
                    front = reach[label[reach] > start]
                    label[front] = start
        query, shard, node = (np.concatenate(c) for c in zip(*onward, strict=True))
        return pa.table({"space": space, "id": pa.array(s.ids), "n": pa.array(count), "to": pa.array(s.ids[label]), "next": _array(query, shard, n), "enter": _array(query, node, n)})

    return rows.groupBy("shard").applyInArrow(run, SEARCHED)


def _visited(members: DataFrame, visits: DataFrame, least: float) -> DataFrame:
    """What ``_links`` gives, of ``visits(shard, space, id, times, v, enter, seen, fresh)`` to other shards.

    A link counts where the query first meets the node: not if a shard that holds the node was ``seen``
    before, nor if one of those visited in the same round comes first. Visitors of a shard are dealt to
    tasks of about ``VISITORS``.
    """
    sizes = visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("p"))
    left = members.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).drop("p")
    right = visits.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("p")).cast("int")).drop("p")

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        s, own = Shard(table), asked.column("shard")[0].as_py()
        ids, raw = asked.column("id").to_numpy(), _vectors(asked)
        seen, fresh = _padded(*_lists(asked, "seen")), _padded(*_lists(asked, "fresh"))
        at = np.searchsorted(s.ids, enter := asked.column("enter").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False))
        at = np.where(s.ids[np.minimum(at, len(s.ids) - 1)] == enter, at, -1)
        count, onward = np.zeros(len(ids), np.int64), []
        label = {}  # the least node of each component of queries and the nodes they meet

        def root(k: int) -> int:
            while label.setdefault(k, k) != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        for a in range(0, len(ids), 256):
            q = np.arange(a, min(len(ids), a + 256))
            (i, j), reached = s.met(raw[q], at[q], least)
            other = s.ids[j] != ids[q[i]]
            i, j = i[other], j[other]
            for x, y in zip(ids[q[i]].tolist(), s.ids[j].tolist(), strict=True):
                x, y = root(x), root(y)
                label[max(x, y)] = min(x, y)
            before = np.zeros(len(i), bool)
            for k in range(s.shards.shape[1]):
                held = s.shards[j, k]
                before |= (held >= 0) & ((held[:, None] == seen[q[i]]).any(1) | ((held < own) & (held[:, None] == fresh[q[i]]).any(1)))
            count[q] += np.bincount(i[~before], s.times[j[~before]], len(q)).astype(np.int64)
            query, shard, node = s.beyond(*reached, np.concatenate([seen[q], fresh[q]], 1))
            onward.append((q[query], shard, node))
        query, shard, node = (np.concatenate(c) for c in zip(*onward, strict=True))
        out = pa.table({"space": asked.column("space"), "id": pa.array(ids), "n": pa.array(count), "to": pa.array([root(k) for k in ids.tolist()], pa.int64()), "next": _array(query, shard, len(ids)), "enter": _array(query, node, len(ids))})
        met = sorted(set(label).difference(ids.tolist()))
        none = pa.array([[]] * len(met), pa.list_(pa.int64()))
        more = pa.table({"space": pa.array([asked.column("space")[0].as_py()] * len(met), pa.string()), "id": pa.array(met, pa.int64()), "n": pa.array(np.zeros(len(met), np.int64)), "to": pa.array([root(k) for k in met], pa.int64()), "next": none, "enter": none})
        return pa.concat_tables([out.cast(more.schema), more])

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, SEARCHED)


def _compared(asked: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """What ``_links`` gives, of ``asked`` with all ``nodes`` of the same space: every pair is compared.

    Both are cut in blocks of about ``SIDE`` and a task has a block of each.
    """
    sizes = asked.groupBy("space").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("p")).join(nodes.groupBy("space").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("q")), "space")

    def dealt(rows: DataFrame, own: str, other: str, ask: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int").alias("i" if ask else "j")
        return rows.join(sizes, "space").select("space", "id", "times", "v", F.lit(ask).alias("ask"), block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("j" if ask else "i"))

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        ids, times, raw = table.column("id").to_numpy(), table.column("times").to_numpy(), _vectors(table)
        norm = np.sqrt((raw * raw).sum(1))
        x, y = ids[a], ids[b]
        count = np.zeros(len(ids), np.int64)
        hits = []
        for k in range(0, len(a), 256):
            hit = (raw[a[k : k + 256]] @ raw[b].T / (norm[a[k : k + 256]][:, None] * norm[b]) >= least) & (x[k : k + 256][:, None] != y)
            p, q = np.nonzero(hit)
            count[a[k : k + 256]] = np.bincount(p, times[b[q]], len(hit)).astype(np.int64)
            hits.append(np.packbits(hit, axis=1))
        label, before = ids.copy(), None
        while before is None or (label != before).any():  # the least node of each component
            before = label.copy()
            for k, bits in zip(range(0, len(a), 256), hits, strict=True):
                p, q = np.nonzero(np.unpackbits(bits, axis=1, count=len(b)))
                rows = a[k : k + 256]
                np.minimum.at(label, rows[p], label[b[q]])
                np.minimum.at(label, b[q], label[rows[p]])
        return pa.table({"space": table.column("space"), "id": pa.array(ids), "n": pa.array(count), "to": pa.array(label)})

    both = dealt(asked, "p", "q", True).unionByName(dealt(nodes, "q", "p", False))
    return both.groupBy("space", "i", "j").applyInArrow(run, FOUND)


class FlatGraph:
    """``link(vectors)`` gives (vec_id, n_links, component_id, kept), a row for each row."""

    def __init__(self, spark: SparkSession, least: float = 0.93) -> None:
        self.spark, self.least, self.recall = spark, least, 1.0

    def _centroids(self, nodes: DataFrame) -> dict[str, np.ndarray]:
        sizes = {r["space"]: r["n"] for r in nodes.groupBy("space").agg(F.count("*").alias("n")).filter(f"n > {SHARD}").orderBy(F.desc("n")).limit(MOST_CENTROIDS // 2).collect()}
        total = sum(sizes.values())
        if not total:
            return {}
        share = min(1.0, MOST_SAMPLE / total)
        wanted = F.broadcast(self.spark.createDataFrame([(s,) for s in sizes], "space string"))
        picked = nodes.join(wanted, "space").filter(sampled(share, "id", "v")).select("space", "v").toArrow()  # MOST_SAMPLE rows or so
        rows = picked.column("space").combine_chunks().dictionary_encode()
        code, (values, per) = rows.indices.to_numpy(zero_copy_only=False), _lists(picked, "v")
        first, most, out = np.cumsum(per) - per, max(1, MOST_CENTROIDS // len(sizes)), {}
        for k, s in enumerate(rows.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            x = gather(values, first[own], per[own]).reshape(len(own), -1)
            out[s] = fit_centroids(x[np.lexsort(x.T[::-1])], min(most, -(-sizes[s] // SHARD)))  # in an order of its own
        return out

    @staticmethod
    def _deal(nodes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
        """A row for each shard of each node, with all its ``shards`` and the ``probes`` it visits besides."""

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                rows = batch.column("space").dictionary_encode()
                code = rows.indices.to_numpy(zero_copy_only=False)
                col = batch.column("v")
                values, starts = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.asarray(col.value_lengths())])
                out, probes = np.full(len(code), None, object), np.full(len(code), None, object)
                for k, s in enumerate(rows.dictionary.to_pylist()):
                    idx = np.flatnonzero(code == k)
                    if s not in centroids:
                        out[idx], probes[idx] = [[f"{s}/0"]] * len(idx), [[]] * len(idx)
                        continue
                    c = centroids[s]
                    for a in range(0, len(idx), 512):
                        part = idx[a : a + 512]
                        x = gather(values, starts[part], starts[part + 1] - starts[part]).reshape(len(part), -1)
                        near = np.argsort(-(x @ c.T), 1, kind="stable")[:, : overlap + PROBES]
                        for i, row in zip(part.tolist(), near.tolist(), strict=True):
                            out[i], probes[i] = [f"{s}/{k}" for k in row[:overlap]], [f"{s}/{k}" for k in row[overlap:]]
                names = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("space", "id", "times", "v")), pa.array(out.tolist(), names), pa.array(probes.tolist(), names)], names=["space", "id", "times", "v", "names", "probes"])

        dealt = nodes.select("id", "times", "v", "space").mapInArrow(run, "space string, id long, times long, v array<double>, names array<string>, probes array<string>")
        hashed = lambda c: F.array_sort(F.transform(c, lambda s: F.xxhash64(s).bitwiseAND(F.lit(2**63 - 1))))
        return dealt.select("space", "id", "times", "v", hashed("names").alias("shards"), hashed("probes").alias("probes")).withColumn("shard", F.explode("shards"))

    def _split(self, dealt: DataFrame) -> DataFrame:
        """``dealt`` with shards of more than ``MOST`` nodes dealt again, each by centroids of its own."""
        big = Table(dealt.groupBy("shard").agg(F.count("*").alias("_n")).filter(f"_n > {MOST}").select("shard"), "large-shards")
        if big.df.isEmpty():
            big.drop()
            return dealt

        def run(table: pa.Table) -> pa.Table:
            table = table.take(pa.array(np.argsort(table.column("id").to_numpy())))
            x, n = _unit(_vectors(table)), table.num_rows
            c = fit_centroids(x[:: -(-n // SHARD_SAMPLE)], -(-n // SHARD))
            near = np.concatenate([np.argsort(-(x[a : a + 512] @ c.T), 1, kind="stable")[:, :2] for a in range(0, n, 512)])
            own = np.uint64(table.column("shard")[0].as_py())
            shard = (mix(own ^ mix(near.ravel().astype(np.uint64) + np.uint64(1))) & np.uint64(2**63 - 1)).astype(np.int64)
            rows = table.take(pa.array(np.repeat(np.arange(n), near.shape[1])))
            return rows.set_column(rows.schema.get_field_index("shard"), "shard", pa.array(shard))

        rows = dealt.drop("shards")
        schema = "space string, id long, times long, v array<double>, probes array<long>, shard long"
        again = rows.join(big.df, "shard", "left_semi").select("space", "id", "times", "v", "probes", "shard").groupBy("shard").applyInArrow(run, schema)
        both = Table(rows.join(big.df, "shard", "left_anti").select(again.columns).unionByName(again), "split").df
        all_ = both.groupBy("space", "id", "v").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        return both.join(all_, ["space", "id", "v"])

    def _searched(self, nodes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
        """Rows of ``FOUND`` from every query's search of the united graph."""
        dealt = Table(self._split(Table(self._deal(nodes, centroids, overlap), "shards").df), "dealt").df
        near = _adjacency(dealt).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        members = Table(dealt.drop("probes").join(Table(near, "graph").df, "id"), "members").df
        found = Table(_links(members, self.least), "found").df
        rounds, been = [found], Table(dealt.select("space", "id", "shard").distinct(), "been").df
        ahead = dealt.select("space", "id", F.explode("probes").alias("shard"), F.lit(None).cast("long").alias("enter")).join(dealt.select("shard").distinct(), "shard", "left_semi")
        while True:
            onward = rounds[-1].select("space", "id", F.explode(F.arrays_zip(F.col("next").alias("s"), F.col("enter").alias("e"))).alias("x")).select("space", "id", F.col("x.s").alias("shard"), F.col("x.e").alias("enter"))
            onward = onward.unionByName(ahead) if ahead is not None else onward
            new = onward.groupBy("space", "id", "shard").agg(F.max("enter").alias("enter")).join(been, ["space", "id", "shard"], "left_anti")
            new, ahead = Table(new, "ahead").df, None
            if new.isEmpty():
                break
            seen = been.groupBy("space", "id").agg(F.collect_set("shard").alias("seen"))
            fresh = new.groupBy("space", "id").agg(F.collect_set("shard").alias("fresh"))
            visits = new.join(fresh, ["space", "id"]).join(seen, ["space", "id"]).join(nodes.select("space", "id", "times", "v"), ["space", "id"])
            visits = Table(visits, "visits").df
            rounds.append(Table(_visited(members, visits, self.least), "found").df)
            been = Table(been.unionByName(new.select("space", "id", "shard")), "been").df
        self.rounds = len(rounds)
        out = rounds[0]
        for df in rounds[1:]:
            out = out.unionByName(df)
        return out.select("space", "id", "n", "to")

    def _audit(self, nodes: DataFrame, found: DataFrame) -> DataFrame:
        """(space, m, n): links that brute force finds and how many of them were found, over all ids divisible by 20.

        A space with fewer than ``LEAST_ASKED`` of them is asked whole.
        """
        few = nodes.groupBy("space").agg(F.count(F.when(F.col("id") % 20 == 0, 1)).alias("asked")).filter(f"asked < {LEAST_ASKED}").select("space", F.lit(True).alias("whole"))
        asked = nodes.join(few, "space", "left").filter("id % 20 = 0 OR whole").drop("whole")
        ids = asked.select("space", "id").distinct()
        true = _compared(asked, nodes, self.least).groupBy("space", "id").agg(F.sum("n").alias("m")).join(ids, ["space", "id"], "left_semi")
        got = found.groupBy("space", "id").agg(F.sum("n").alias("n"))
        return true.join(got, ["space", "id"], "left").groupBy("space").agg(F.sum("m").alias("m"), F.sum(F.least("m", F.coalesce("n", F.lit(0)))).alias("n"))

    def link(self, vectors: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
        good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
        rows = rows.withColumn("space", F.when(good, F.concat_ws("|", F.size("v").cast("string"), "label")))
        # Zeros of either sign are one value, as in a comparison.
        rows = rows.withColumn("v", F.when(F.col("space").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
        held = Table(rows.filter("space IS NOT NULL").select("vec_id", "space", "v").distinct().groupBy("space", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")), "nodes").df
        # One id with several vectors is one node for each in its own shard row; the id joins them.
        centroids, overlap = self._centroids(held), OVERLAP
        rest, settled, links, true = held, [], 0, 0
        of = lambda spaces: F.broadcast(self.spark.createDataFrame([(s,) for s in spaces], "space string"))
        while True:
            found = self._searched(rest, centroids, overlap)
            audit = Table(self._audit(rest, found), "audit").df
            short = {r["space"]: r["m"] for r in audit.filter(f"n < {LEAST_RECALL} * m").collect()}
            total = audit.filter(f"n >= {LEAST_RECALL} * m").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
            links, true = links + (total["n"] or 0), true + (total["m"] or 0)
            if not short:
                settled.append(found)
                break
            settled.append(found.join(of(short), "space", "left_anti"))
            last = [s for s in short if 2 * overlap >= len(centroids.get(s, ()))]
            if last:
                nodes = held.join(of(last), "space")
                settled.append(Table(_compared(nodes, nodes, self.least), "compared").df)
                links, true = links + sum(short[s] for s in last), true + sum(short[s] for s in last)
            rest = held.join(of(short.keys() - set(last)), "space")
            if len(last) == len(short):
                break
            overlap *= 2
        self.recall = links / true if true else 1.0
        found = settled[0]
        for df in settled[1:]:
            found = found.unionByName(df)
        counted = Table(found.groupBy("id").agg(F.sum("n").alias("n")), "counted").df
        comp = components(found.filter("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
        nodes = held.join(counted, "id").join(comp, "id", "left").select("space", "v", (F.col("n") + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        nodes = Table(nodes, "linked").df
        out = rows.select("vec_id", "space", "v").join(nodes, ["space", "v"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlatGraph(spark, 0.93).link(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.c = p.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
