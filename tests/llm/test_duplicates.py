"""Near copies, repeated passages and near vectors against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkflow.llm import flatgraph, minhash, suffixdedup
from chunkflow.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def closure(ids, pairs):
    parent = {i: i for i in ids}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    ids = {i for p in linked for i in p}
    assert got == closure(ids, linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_equal_brute_force(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(12):
        first = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(rng.choice([1, 2, 30])):
            copy = first[:]
            for j in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 25))):
                copy[j] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "one two", "ONE\ttwo", "one two three", "É é", "é É", texts[0], "x " * 3000, "x " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    pairs = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closure(sets, pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.NearDuplicates(spark, size, 80).link(docs).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_blocks_of_a_wide_bucket_meet(spark, monkeypatch):
    """Families whose leader links with few: what stays apart is compared block by block."""
    monkeypatch.setattr(minhash, "SIDE", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        copy = base[:]
        for j in rng.sample(range(60), 2):
            copy[j] = f"z{rng.randrange(10_000)}"
        texts += [" ".join(copy), " ".join([*copy, "tail"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    want = closure(sets, [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in minhash.NearDuplicates(spark, 4, 80).link(docs).collect()}
    assert got == want and len(set(want.values())) > 1


def test_words_that_a_polynomial_cannot_tell_apart_stay_apart(spark):
    """Thue-Morse words collide modulo 2^64 whatever the base; here they are words, and parts of shingles."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(40))
    rows = [one, other, f"{one} {tail}", f"{other} {other} {tail[:30]}", f"{one} b c d", f"{other} b c d"]
    got = {r.doc_id: r.component_id for r in minhash.NearDuplicates(spark, 4, 80).link(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(6)}


def test_very_long_texts_and_columns_of_any_name(spark):
    """Texts of several pieces, and one word longer than a piece."""
    rng = random.Random(3)
    words = rng.choices([f"word{i}" for i in range(5000)], k=120_000)
    copy = words[:]
    for j in rng.sample(range(len(copy)), 2000):
        copy[j] = "other"
    rows = [" ".join(words), " ".join(copy), "x" * 600_000, "x" * 600_000 + " y"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("set", F.lit(2)).withColumn("rep", F.lit(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.NearDuplicates(spark, 4, 80).link(docs).collect()}
    sets = [shingles(t, 4) for t in rows]
    assert got == {0: (len(sets[0]), 0), 1: (len(sets[1]), 0), 2: (1, 2), 3: (1, 3)}


def test_near_copies_without_ids_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "p q r s t u")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.NearDuplicates(spark).link(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (3, 3, True), (3, 3, True)]
    assert minhash.NearDuplicates(spark).link(docs.limit(0)).count() == 0


def test_sketches_fill_and_agree_as_sets_do():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(1, 2**63, 100).astype(np.uint64)])
    s = minhash.sketches(np.repeat([0, 1, 2], [1000, 1000, 1]), np.concatenate([a, b, a[:1]]), 3)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.15


def removed(texts, length):
    raw = {i: (t or "").encode() for i, t in texts}
    first = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][p : p + length], i)
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [4096, 3, 12])
def test_repeats_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    if heavy == 12:  # long texts are named in pieces
        monkeypatch.setattr(suffixdedup, "CHUNK", 700)
    rng = random.Random(6)
    line = lambda n: "".join(rng.choices("abé \n", k=n))
    shared = [line(n) for n in (49, 50, 51, 80, 200, 400)]
    texts = [(None, shared[4])]
    for i in range(60):
        texts.append((i, "".join(rng.choice([line(rng.randrange(60)), rng.choice(shared), shared[5][rng.randrange(100) : rng.randrange(100, 400)]]) for _ in range(4))))
    texts += [(70, None), (71, ""), (72, "a" * 3000), (73, "a" * 2000 + "b"), (74, shared[3] * 3), (75, texts[5][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    want = removed([t for t in texts if t[0] is not None], 50)
    got = suffixdedup.remove_repeats(docs, 50).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got if r.doc_id is not None} == want
    assert next(r.n_removed for r in got if r.doc_id is None) == 0


def test_rows_of_one_id_and_no_rows(spark):
    s = "q" * 20 + "".join(chr(97 + i % 23) for i in range(90))
    docs = spark.createDataFrame([(1, s), (1, s), (1, s + "z"), (2, s), (2, "other " + s)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(docs, 50).collect())
    assert got == [(1, 110, 0), (1, 110, 0), (1, 111, 0), (2, 110, 110), (2, 116, 110)]
    assert suffixdedup.remove_repeats(docs.limit(0), 50).count() == 0
    with pytest.raises(ValueError):
        suffixdedup.remove_repeats(docs, 20)


def test_runs_of_a_long_text_do_not_hang_on_its_pieces(monkeypatch):
    rng = random.Random(2)
    raw = ["".join(rng.choices("ab", k=n)).encode() for n in (3000, 0, 49, 50, 700, 701, 1400)] + [b"a" * 2500]
    whole = suffixdedup.named_runs(raw, 50)
    for size in (60, 333, 700):
        monkeypatch.setattr(suffixdedup, "CHUNK", size)
        assert all(np.array_equal(x, y) for x, y in zip(suffixdedup.named_runs(raw, 50), whole))


def test_previous_factors_equal_their_definition():
    rng = np.random.default_rng(4)
    for length in (8, 21, 50):
        data = rng.integers(0, 2, 400).astype(np.uint8) if length < 50 else np.tile(rng.integers(0, 5, 90).astype(np.uint8), 5)
        at = np.arange(len(data) - length)
        doc = np.sort(rng.integers(0, 6, len(at)))[rng.permutation(len(at))]
        got = suffixdedup.longest_previous_factors(data, at, doc, length)
        raw, want = data.tobytes(), []
        for p, d in zip(at.tolist(), doc.tolist()):
            best = 0
            for q, e in zip(at.tolist(), doc.tolist()):
                if e < d:
                    while best < length and raw[p : p + best + 1] == raw[q : q + best + 1]:
                        best += 1
            want.append(best)
        assert got.tolist() == want and (length < 50 or 0 < np.mean(got >= length) < 1)
    assert len(suffixdedup.longest_previous_factors(data, at[:0], doc[:0], 50)) == 0


def test_classes_take_memory_by_the_chunk():
    data = np.random.default_rng(8).integers(0, 256, 8 << 20).astype(np.uint8)
    size = np.full(len(data) // 512, 512)
    start = np.cumsum(size) - size
    data[start[-1] :] = data[start[3] : start[4]]
    tracemalloc.start()
    try:
        cls = suffixdedup.content_classes(data, start, size)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cls[-1] == cls[3] and len(np.unique(cls)) == len(cls) - 1
    assert most < 6 * len(data) and len(suffixdedup._powers[0]) <= 1 << 20


def test_classes_of_slices_above_the_chunk(monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 64)
    data = np.frombuffer(b"ab" * 50 + b"ab" * 50 + b"c" * 30 + b"ab" * 49 + b"xx" + b"c" * 30, np.uint8)
    size = np.array([100, 100, 30, 100, 30])
    cls = suffixdedup.content_classes(data, np.cumsum(size) - size, size).tolist()
    assert cls[0] == cls[1] and cls[2] == cls[4] and len(set(cls)) == 3


@pytest.mark.parametrize("chunk", [1, 300, 1 << 19])
def test_repeated_runs_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
    rng = random.Random(9)
    slices = ["".join(rng.choices("ab", k=rng.randrange(12, 40))).encode() for _ in range(60)]
    name, doc = [rng.randrange(7) for _ in slices], [rng.randrange(20) for _ in slices]
    size = np.array([len(x) for x in slices])
    got = set()
    for i, p, n in zip(*suffixdedup.repeated_runs(np.frombuffer(b"".join(slices), np.uint8), np.cumsum(size) - size, size, np.array(name), np.array(doc), 8)):
        new = {(i, q) for q in range(p, p + n)}
        assert n > 0 and not got & new
        got |= new
    # Names are given at random here: those of one name must be compared, those of one chunk may be.
    near = {(i, p) for i, x in enumerate(slices) for p in range(len(x) - 7) if any(doc[j] < doc[i] and name[j] == name[i] and x[p : p + 8] in y for j, y in enumerate(slices))}
    far = {(i, p) for i, x in enumerate(slices) for p in range(len(x) - 7) if any(doc[j] < doc[i] and x[p : p + 8] in y for j, y in enumerate(slices))}
    assert near <= got <= far and (chunk > 1 or got == near) and near


def test_groups_go_by_the_bytes_of_texts_not_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP_BITS", 15)
    monkeypatch.setattr(suffixdedup, "SPREAD", 1)
    path = str(tmp_path / "documents.parquet")
    spark.range(320).selectExpr("id AS doc_id", "repeat('a', 16384) AS text").coalesce(1).write.parquet(path)
    out = suffixdedup.remove_repeats(spark.read.parquet(path), 50)
    assert re.search(r"RepartitionByExpression \[part#\d+\], 160\b", out._jdf.queryExecution().analyzed().toString())
    assert sum(r.n_removed for r in out.select("n_removed").collect()) == 319 * 16384


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(260):
        center = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 4, 12])):
            rows.append((i, (center + 0.18 * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    rows += [(i + k, rows[0][1], rows[0][2]) for k in range(5)] + [(i + 9, rows[0][1], None), (i + 10, None, 0), (i + 11, [0.0] * 16, 0), (i + 12, [float("nan")] * 16, 0), (i + 13, [None] * 16, 0), (i + 14, [1.0] * 3, 0), (i + 15, [], 0), (None, rows[0][1], rows[0][2]), rows[3]]
    graph = flatgraph.FlatGraph(spark, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.link(vectors(spark, rows)).collect() if r.vec_id is not None}
    good = [r for r in {r[0]: r for r in rows if r[0] is not None}.values() if r[1] and r[2] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in good], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    same = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (same[:, None] == same) & ~np.eye(len(x), dtype=bool)
    pairs = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near))]
    want = closure([r[0] for r in rows if r[0] is not None], pairs)
    n = {r[0]: int(m) for r, m in zip(good, near.sum(1))}
    found = sum(got[i][0] for i in got)
    assert graph.recall >= 0.9 and 0.99 * near.sum() <= found <= near.sum()
    assert all(k <= n.get(i, 0) for i, (k, _) in got.items())
    assert np.mean([got[i][1] == c for i, c in want.items()]) > 0.99


def test_no_vectors(spark):
    assert flatgraph.FlatGraph(spark).link(vectors(spark, [(1, [1.0], 0)]).limit(0)).count() == 0


def brute_links(rows, least=0.93):
    by = {}
    for i, v, label in rows:
        by.setdefault(label, []).append((i, np.array(v, np.float32).astype(float)))
    pairs = []
    for group in by.values():
        x = np.array([v for _, v in group])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        pairs += [(group[i][0], group[j][0]) for i, j in zip(*np.nonzero(x @ x.T >= least)) if i != j]
    return pairs


def groups(rng, sizes, dims=24, noise=0.04):
    for n in sizes:
        base = rng.normal(size=dims)
        base /= np.sqrt(base @ base)
        yield from (base + rng.normal(size=(n, dims)) * noise).astype(np.float32).tolist()


def test_groups_wider_than_the_candidates_keep_their_links(spark):
    """More near vectors than candidates: no edge leaves a group, and one label is a single shard."""
    rng = np.random.default_rng(21)
    rows = [(i, v, 1) for i, v in enumerate(groups(rng, [60] * 7))]
    pairs = brute_links(rows)
    graph = flatgraph.FlatGraph(spark, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.link(vectors(spark, rows)).collect()}
    want = closure([i for i, _, _ in rows], pairs)
    assert len(pairs) > 10_000 and sum(n for n, _ in got.values()) >= 0.99 * len(pairs)
    assert {i: c for i, (_, c) in got.items()} == want


def brute_graph(rows):
    pairs = brute_links(rows)
    n, want = Counter(a for a, _ in pairs), closure([i for i, _, _ in rows], pairs)
    return {i: (n[i], want[i]) for i in want}


@pytest.mark.parametrize("most", [4000, 120])
def test_searches_cross_shards(spark, monkeypatch, most):
    """More than twenty shards of two each, groups wider than a shard, and large shards dealt again."""
    monkeypatch.setattr(flatgraph, "SHARD", 50)
    monkeypatch.setattr(flatgraph, "MOST", most)
    monkeypatch.setattr(flatgraph, "LEAST_RECALL", 0.0)  # what the search finds, not what is mended after it
    rng = np.random.default_rng(31)
    rows = [(i, v, 1) for i, v in enumerate(groups(rng, [1] * 300 + [3] * 150 + [30] * 10 + [240], noise=0.05))]
    graph = flatgraph.FlatGraph(spark, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.link(vectors(spark, rows)).collect()}
    want = brute_graph(rows)
    found, true = (sum(n for n, _ in x.values()) for x in (got, want))
    assert len(rows) / 50 > 20 and graph.rounds > 1 and graph.recall > 0.99
    assert 0.999 * true <= found <= true and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.999


def test_links_between_vectors_without_a_common_shard_are_counted_once(spark):
    """Two shards by hand, one node in both: the ends of the chain meet by a visit, from either side."""
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    at = {1: 0.0, 2: 0.15, 3: 0.3, 4: 1.5}
    rows = [(f"2|1", i, 1, angle(a), s, sh) for i, a in at.items() for s in {1: [10], 2: [10, 20], 3: [20], 4: [20]}[i] for sh in [{1: [10], 2: [10, 20], 3: [20], 4: [20]}[i]]]
    near = {1: [2], 2: [1, 3], 3: [2, 4], 4: [3]}
    members = spark.createDataFrame([(*r, near[r[1]]) for r in rows], "space string, id long, times long, v array<double>, shard long, shards array<long>, near array<long>")
    home = flatgraph._links(members, 0.93).collect()
    assert {(r.id, tuple(r.next), tuple(r.enter)) for r in home if r.next} == {(1, (20,), (2,)), (3, (10,), (2,))}
    visits = spark.createDataFrame([(20, "2|1", 1, 1, angle(at[1]), 2, [10], [20]), (10, "2|1", 3, 1, angle(at[3]), 2, [20], [10])], "shard long, space string, id long, times long, v array<double>, enter long, seen array<long>, fresh array<long>")
    more = flatgraph._visited(members, visits, 0.93).collect()
    n = Counter()
    for r in home + more:
        n[r.id] += r.n
    assert n == {1: 2, 2: 2, 3: 2, 4: 0} and {r.to for r in more} == {1}


def test_labels_short_of_the_floor_are_compared_whole(spark, monkeypatch):
    """A search that finds nothing leaves no result behind: all pairs are compared, in several blocks."""
    monkeypatch.setattr(flatgraph, "SIDE", 64)
    monkeypatch.setattr(flatgraph, "_links", lambda rows, least: rows.select("space", "id", F.lit(0).cast("long").alias("n"), F.col("id").alias("to"), *(F.array().cast("array<long>").alias(c) for c in ("next", "enter"))))
    rng = np.random.default_rng(22)
    rows = [(i, v, 1) for i, v in enumerate(groups(rng, [40, 70, 1, 2, 90]))]
    pairs = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.FlatGraph(spark, 0.93).link(vectors(spark, rows)).collect()}
    want = closure([i for i, _, _ in rows], pairs)
    assert got == {i: (sum(a == i for a, _ in pairs), want[i]) for i in want}


def test_audit_asks_every_query_of_every_label(spark):
    """A small label without ids divisible by 20 that finds nothing does not hide behind a large one."""
    rng = np.random.default_rng(23)
    rows = [(20 * i, v, 1) for i, v in enumerate(groups(rng, [30] * 150, noise=0.02))] + [(20 * i + 1, v, 2) for i, v in enumerate(groups(rng, [12]))]
    nodes = spark.createDataFrame([(f"24|{k}", i, 1, v) for i, v, k in rows], "space string, id long, times long, v array<double>")
    pairs = brute_links(rows)
    found = spark.createDataFrame([("24|1", i, n, i) for i, n in Counter(a for a, _ in pairs).items() if i % 20 == 0], "space string, id long, n long, to long")
    got = {r.space: (r.m, r.n) for r in flatgraph.FlatGraph(spark, 0.93)._audit(nodes, found).collect()}
    large = sum(a % 20 == 0 for a, _ in pairs)
    assert got == {"24|1": (large, large), "24|2": (len(pairs) - large, 0)}


def test_pairs_at_the_threshold_share_a_band():
    """Bands over half of the coordinates leave about one such pair in 4,600 without a bucket."""
    texts = []
    for i in range(12_000):
        common = [f"c{i}_{j}" for j in range(40)]
        texts += [" ".join([*common, *(f"{side}{i}_{j}" for j in range(5))]) for side in "ab"]  # similarity 40 / 50
    bands = np.concatenate([minhash.signature(texts[a : a + 2000], 1)["bands"] for a in range(0, len(texts), 2000)])
    assert bands.shape[1] * minhash.ROWS == minhash.T
    assert (bands[0::2] == bands[1::2]).any(1).all()
