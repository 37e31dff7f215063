"""Language identification, toxicity and decontamination: held-out accuracy and planted cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkflow.llm import decontam, langid, toxicity
from chunkflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_codewords_differ_in_half_their_bits():
    for n in (2, 4, 9, 30):
        c = langid.hadamard(max(2 * n, 4))[1 : n + 1, 1:]
        assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= len(c[0]) // 2


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op2_langid"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    model = langid.fit([("the cat and the hat " * 5, "en"), ("der hund und das haus " * 5, "de")] * 3)
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "the the and"), (None, "und der hund"), (6, "der" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", None: "de", 6: "de"}
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit([])).collect()} == {"und"}


def test_toxic_documents_are_found(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        t = rng.choices(words, k=30)
        bad = i % 5 == 0
        rows.append((i, " ".join(t + (["vile", "they"] if bad else ["vile"] if i % 5 == 1 else ["they"] if i % 5 == 2 else [])), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") % 3 != 0)
    got = toxicity.predict(docs, model).filter("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97  # needs the pair: either word alone is clean


def test_interactions_are_those_of_the_formula():
    m = toxicity.Model(0.5, np.zeros(1 << toxicity.BITS, np.float32), np.full(1 << toxicity.BITS, -1, np.int32), np.random.default_rng(0).normal(size=(3, toxicity.FACTORS)).astype(np.float32))
    m.row[[1, 2, 3]], m.weight[[1, 2, 3]] = [0, 1, 2], [1, 2, 3]
    v = m.factor.astype(float)
    want = 0.5 + 6 + v[0] @ v[1] + v[0] @ v[2] + v[1] @ v[2]
    assert toxicity._sums(m, 1, np.zeros(3, int), np.array([1, 2, 3]))[0] == pytest.approx(want, rel=1e-5)


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "x" * 100_000), (1, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(df, none, F.lit(True))
    assert [r.predicted for r in toxicity.predict(df, model).collect()] == [0] * 4
    one = spark.createDataFrame([(1, None), (1, 1), (None, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.predict(df, toxicity.train(df, one, F.lit(True))).collect()} == {1}
    assert toxicity.predict(df.limit(0), model).count() == 0


def _corpus(n=400):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    return rng, words, [" ".join(rng.choices(words, k=120)) for _ in range(n)]


def test_leaks_and_paraphrases_are_found_and_clean_texts_left(spark):
    rng, words, texts = _corpus()
    items = [" ".join(rng.choices(words, k=rng.randint(18, 50))) for _ in range(20)]
    planted = {}
    for i in range(0, 200, 5):
        item = items[i % 20].split()
        if i % 10:
            for j in rng.sample(range(len(item)), len(item) // 10):
                item[j] = rng.choice(words)
        texts[i] = f"{texts[i]} {' '.join(item)} {texts[i + 1]}"
        planted[i] = i % 20
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (1000, "")], "doc_id long, text string").withColumn("share", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items), (None, "x"), (77, None), (78, "!!")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.detect(docs, bench).collect()}
    assert len(got) == 402
    missed = [i for i, k in planted.items() if k not in got[i].item_ids]
    wrong = [i for i, r in got.items() if r.contaminated and i not in planted]
    assert len(missed) <= 1 and not wrong
    assert not any(r.contaminated for r in decontam.detect(docs, bench.limit(0)).collect())
    assert decontam.detect(docs.limit(0), bench).count() == 0


def test_subsequence_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prior = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prior[j] + 1 if x == y else max(prior[j + 1], row[j])
        places = {}
        for j, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << j
        assert decontam.common_subsequence(places, len(a), b) == row[-1]


def test_all_that_the_word_check_accepts_is_found(monkeypatch):
    """Short items, whole and in part, in long texts: results equal a check of every stretch of every text."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    items = [rng.choices(vocab, k=rng.choice([6, 10, 14, 18, 24, 40])) for _ in range(40)]
    texts = []
    for i in range(240):
        item = items[i % 40]
        gone = set(rng.sample(range(len(item)), int(len(item) * rng.choice([0, 0.1, 0.2, 0.3, 0.35]))))
        part = [rng.choice(vocab) if j in gone and rng.random() < 0.5 else x for j, x in enumerate(item) if j not in gone or rng.random() < 0.6]
        at = rng.randrange(100)
        texts.append(" ".join(rng.choices(vocab, k=at) + part + rng.choices(vocab, k=140 - at)))
    texts += [None, "", " ".join(items[0] + ["x"] * 50 + items[0][:3])]
    noise = np.random.default_rng(3)
    idf = noise.uniform(1, 9, 1 << decontam.BITS).astype(np.float32)
    index = decontam.item_index([(k, " ".join(x)) for k, x in enumerate(items)], idf, noise.normal(size=(1 << decontam.BITS, decontam.RANK)).astype(np.float32))
    want = []
    for t in texts:
        h = decontam.Words([t], decontam.PUNCTUATION).hashes.tolist()
        found = {}
        for k, words in enumerate(index.words):
            size, rare = len(words), index.rare[k]
            span = size + max(4, size // 3)
            for a in range(max(1, len(h) - span + 1)):
                part = h[a : a + span]
                if len(rare.intersection(part)) >= 0.5 * len(rare):
                    share = decontam.common_subsequence(index.places[k], size, part) / size
                    if share >= 0.7:
                        found[k] = max(found.get(k, 0.0), share)
        want.append(found)
    assert sum(map(len, want)) > 150 and decontam.matches(index, texts) == want
    monkeypatch.setattr(decontam, "PAIRS", 50, raising=False)
    assert decontam.matches(index, texts) == want


def additive(texts, toxic, held):
    """A logistic model without pairs, over the same terms: the control that must fail where only pairs tell."""
    w, step = np.zeros(1 << toxicity.BITS), 0.5
    parts = [toxicity.terms([t]) [1] for t in texts]
    b = 0.0
    for _ in range(60):
        for terms, y in zip(parts, toxic):
            e = 1 / (1 + np.exp(-np.clip(b + w[terms].sum(), -30, 30))) - y
            w[terms] -= step * e / len(terms)
            b -= step * e / len(terms)
    return np.array([b + w[toxicity.terms([t])[1]].sum() > 0 for t in held])


def test_pairs_that_are_toxic_only_one_by_one_are_learned():
    """Either word alone is toxic, both or none are not: no term says anything by itself."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]

    def draw(n):
        out = []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            out.append((" ".join(rng.choices(words, k=30) + ["vile"] * a + ["they"] * b), int(a != b)))
        return [t for t, _ in out], np.array([y for _, y in out], float)

    (texts, toxic), (held, truth) = draw(1500), draw(500)
    got = toxicity.probability(toxicity.fit(texts, toxic, 0.5), held) >= 0.5
    assert np.mean(got == truth) > 0.9
    assert np.mean(additive(texts[:400], toxic[:400], held) == truth) < 0.65


def test_pair_screen_equals_plain_counts():
    rng = np.random.default_rng(6)
    x = rng.random((700, 6)) < 0.4
    y = (x[:, 0] ^ x[:, 1]) * 1.0
    text, term = np.nonzero(x)
    assert toxicity.interacting(text, term, y, 8, 6.0).tolist() == [True, True] + [False] * 6
    assert not toxicity.interacting(text, term, x[:, 0] * 1.0, 8, 6.0).any()


def test_toxicity_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out}
    caught = sum(got[i].predicted for i, t in truth.items() if t)
    assert caught >= 0.85 * sum(truth.values()) and sum(got[i].predicted for i, t in truth.items() if not t) <= 5
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 50 = 0").collect()}
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    for i, t in texts.items():  # the sum over all pairs, term by term
        ids = [k for k in toxicity.terms([t], model.row >= 0)[1]]
        v = model.factor[model.row[ids]].astype(float)
        z = model.intercept + model.weight[ids].astype(float).sum() + sum(v[a] @ v[b] for a in range(len(ids)) for b in range(a))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)


def test_shares_of_any_table_are_met(spark):
    """A share far under one in a million rows still picks rows, as 1e10 rows would need."""
    from chunkflow.llm.scratch import sampled

    df = spark.range(2_000_000)
    assert abs(df.filter(sampled(1e-4, "id")).count() - 200) < 60
    tiny = [df.select(F.min(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 53)))).first()[0] / 2**53]
    assert df.filter(sampled(tiny[0] * 1.001, "id")).count() == 1 and 0 < tiny[0] < 1e-5
    assert df.filter(sampled(F.lit(1.0), "id")).count() == 2_000_000 and df.filter(sampled(0.0, "id")).count() == 0


def test_language_scores_equal_a_plain_decoder(spark):
    """Margins from counts of every n-gram, losses bit by bit: the query's model scored by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(langid.sample(docs, rest != 2))
    got = {r.doc_id: r for r in QUERIES["op2_langid"](spark, SF).collect()}
    for r in docs.filter("doc_id % 97 = 0").collect():
        t = "".join(chr(c) if 97 <= c < 123 else " " if c < 128 else chr(c) for c in (r.text or "").lower().encode())
        codes, z = [ord(c) for c in t + "  "], []
        for b in range(model.codes.shape[1]):
            m = 0.0
            for x, y, w in zip(codes, codes[1:], [*codes[2:], 32]):
                three = (((x << 16 | y << 8 | w) * 2654435761) & 0xFFFFFFFF) >> 16
                m += float(model.weights[b][x << 8 | y]) + float(model.weights[b][langid.BUCKETS + three])
            z.append(m / len(codes) * model.scale[b][0] + model.scale[b][1])
        loss = [sum(np.log1p(np.exp(-x * c)) * tr for x, c, tr in zip(z, code, model.trust)) / model.trust.sum() for code in model.codes]
        share = np.exp(-(np.array(loss) - min(loss)) * len(z))
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmin(loss))]
        assert got[r.doc_id].score == pytest.approx(share.max() / share.sum(), abs=1e-3)


def test_pieces_of_a_long_text_sum_up(monkeypatch):
    model = langid.fit([("the cat and the hat " * 5, "en"), ("der hund und das haus " * 5, "de")] * 3)
    texts = ["the der hat " * 400 + "é", "", "x", "das haus " * 333]
    whole = langid.margins(model.weights, texts)
    for size in (7, 100, 1000):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert np.allclose(langid.margins(model.weights, texts), whole, atol=1e-6)


def test_many_languages_have_short_codewords_far_apart():
    c = langid.codewords(200)
    assert c.shape == (200, langid.BITS) and min((c[i] != c[j]).sum() for i in range(200) for j in range(i)) >= langid.BITS // 4
    rng, rows = random.Random(3), []
    for k in range(40):
        words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(30)]
        rows += [(" ".join(rng.choices(words, k=40)), f"l{k}") for _ in range(8)]
    model = langid.fit(rows[::2])
    order, _, _ = langid.decode(model, langid.margins(model.weights, [t for t, _ in rows[1::2]]))
    assert np.mean([model.languages[o[0]] == y for o, (_, y) in zip(order, rows[1::2])]) > 0.95


def test_decontamination_query_equals_a_check_of_every_stretch(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op3_decontamination"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    idf, sample = decontam.corpus_statistics(docs)
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    index = decontam.item_index(items, idf, np.zeros((1 << decontam.BITS, decontam.RANK), np.float32))
    for r in docs.select("doc_id", "text").collect():
        h = decontam.Words([r.text], decontam.PUNCTUATION).hashes.tolist()
        found = {}
        for k, own in enumerate(index.words):
            size, rare = len(own), index.rare[k]
            span = size + max(4, size // 3)
            if len(rare.intersection(h)) >= 0.5 * len(rare):
                for a in range(max(1, len(h) - span + 1)):
                    part = h[a : a + span]
                    if len(rare.intersection(part)) >= 0.5 * len(rare):
                        share = decontam.common_subsequence(index.places[k], size, part) / size
                        if share >= 0.7:
                            found[index.ids[k]] = max(found.get(index.ids[k], 0.0), share)
        assert list(got[r.doc_id].item_ids) == sorted(found) and got[r.doc_id].share == pytest.approx(max(found.values(), default=0.0))
        assert got[r.doc_id].contaminated == bool(found)


def test_the_sample_hangs_on_rows_not_on_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    docs.repartition(7).write.option("compression", "none").parquet(f"{tmp_path}/a")
    docs.unionByName(docs.filter("length(text) > 3000")).repartition(2).write.option("compression", "gzip").parquet(f"{tmp_path}/b")
    picked = lambda p: sorted(bytes(r.passage) for r in decontam.corpus_statistics(spark.read.parquet(p))[1].df.collect())
    few, decontam.SAMPLE = decontam.SAMPLE, 500
    try:
        one, two = picked(f"{tmp_path}/a"), picked(f"{tmp_path}/b")
    finally:
        decontam.SAMPLE = few
    assert len(one) == 500 and one == two  # repeated texts count once


def test_slices_of_a_benchmark_and_long_texts(spark, monkeypatch):
    rng, words, texts = _corpus(60)
    items = [" ".join(rng.choices(words, k=30)) for _ in range(9)]
    texts[3] += " " + items[2]
    texts[5] = " ".join([*texts[6:], items[7]] * 8)
    texts[9] = items[1] + " " + items[8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_ids", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = {r.doc_id: (list(r.item_ids), r.share) for r in decontam.detect(docs, bench).collect()}
    monkeypatch.setattr(decontam, "SLICE", 4)
    assert {r.doc_id: (list(r.item_ids), r.share) for r in decontam.detect(docs, bench).collect()} == whole
    assert {i: k for i, (k, _) in whole.items() if k} == {3: [2], 5: [7], 9: [1, 8]}
