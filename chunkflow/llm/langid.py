"""Language identification by error-correcting output codes.

Each language has a codeword. Up to 32 languages take rows of a Hadamard matrix without its constant
column, so any two differ in half their bits or more; more languages take random words of ``BITS`` bits,
each of which differs from all before it in a quarter of them at least, so the model does not grow with
the square of their number. One binary n-gram classifier per bit weighs hashed byte bigrams and
trigrams of the lower-cased text by their log-odds. Decoding takes the codeword with the least sum of
logistic losses, each bit weighted by how reliable it was in training, and flags texts for which the
second codeword is nearly as close.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a row gives a row, so
null and repeated ids are kept; with nothing to learn from, every text is ``und``; a long text is scored
whole, piece by piece; further columns of the input are kept, one named like an
output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.llm.bpe import CHUNK, _map, _with_columns, chunks, parts
from chunkflow.llm.scratch import sampled

LETTER = re.compile(r"[^\W\d_]")
#: Hash space of each n-gram order; bits of the codewords of more than 32 languages.
BUCKETS, BITS = 1 << 16, 64


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x (2 * BUCKETS), float32
    scale: np.ndarray  # bits: slope and intercept of the margin
    trust: np.ndarray  # bits


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """Rows of +1 and -1 for ``n`` languages."""
    if n <= BITS // 2:
        return hadamard(max(2 * n, 4))[1 : n + 1, 1:]
    rng, out = np.random.default_rng(seed), np.zeros((0, BITS))
    while len(out) < n:
        word = rng.choice([-1.0, 1.0], BITS)
        if (np.abs(out @ word) <= BITS / 2).all():  # a quarter of the bits at least differ, from its opposite too
            out = np.vstack([out, word])
    return out


def _lowered(texts: list[str]) -> list[bytes]:
    return [t.lower().encode() for t in texts]


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the bigram and of the trigram at each byte of lower-cased texts, and where texts start.

    Everything but letters counts as one blank, and so do the bytes between two texts.
    """
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    data = table[np.frombuffer(b"  ".join([*raw, b""]) + b" ", np.uint8)]
    starts = np.cumsum([0, *(len(r) + 2 for r in raw)])[:-1]
    two = data[:-2] << np.uint32(8) | data[1:-1]
    three = ((two << np.uint32(8) | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    return two, three + np.uint32(BUCKETS), starts


def margins(model_weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Mean log-odds per n-gram position, texts x bits. A long text is summed up piece by piece."""
    raw = _lowered(texts)
    pieces = [(i, a) for i, r in enumerate(raw) for a in range(0, max(1, len(r)), CHUNK)]
    whole = [len(raw[i]) <= CHUNK for i, _ in pieces]
    part = [raw[i] if w else raw[i][a : a + CHUNK + 2] for (i, a), w in zip(pieces, whole, strict=True)]
    out, n = np.zeros((len(texts), len(model_weights))), np.zeros(len(texts))
    for lo, hi in chunks(part):
        two, three, starts = grams(part[lo:hi])
        ends = np.append(starts[1:], len(two) + 1)
        # Two more bytes end the last n-grams of a piece that is not the last; their own are the next piece's.
        last = np.array([a + CHUNK >= len(raw[i]) for i, a in pieces[lo:hi]])
        ends = np.where(last, ends, starts + CHUNK)
        own = np.array([i for i, _ in pieces[lo:hi]])
        np.add.at(n, own, ends - starts)
        edges = np.ravel(np.column_stack([starts, np.minimum(ends, len(two))]))
        for b, w in enumerate(model_weights):
            sums = np.add.reduceat(np.append(w[two] + w[three], np.float32(0)), edges, dtype=np.float64)[0::2]
            np.add.at(out[:, b], own, sums)
    return out / np.maximum(n, 1)[:, None]


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Learns from (text, language) pairs."""
    rows = [(t, y) for t, y in rows if t and LETTER.search(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    codes = codewords(len(languages))
    sums = {sign: np.zeros((codes.shape[1], 2 * BUCKETS), np.float32) for sign in (1, -1)}  # of the languages on either side of a bit
    for k, y in enumerate(languages):
        c = np.full(2 * BUCKETS, 0.05)
        own = _lowered([t for t, z in rows if z == y])
        for a, b in chunks(own):
            two, three, _ = grams(own[a:b])
            c += np.bincount(two, minlength=2 * BUCKETS) + np.bincount(three, minlength=2 * BUCKETS)
        for b, sign in enumerate(codes[k]):
            sums[int(sign)][b] += (c / c.sum()).astype(np.float32)
    weights = np.zeros((codes.shape[1], 2 * BUCKETS), np.float32)
    for b in range(codes.shape[1]):
        plus, minus = (codes[:, b] > 0).sum(), (codes[:, b] < 0).sum()
        if plus and minus:
            weights[b] = np.log(sums[1][b] / plus) - np.log(sums[-1][b] / minus)
    del sums
    of = {y: k for k, y in enumerate(languages)}
    truth = codes[[of[y] for _, y in rows]]
    texts = [t for t, _ in rows]
    m = np.concatenate([margins(weights, texts[a:b]) for a, b in chunks(texts)])
    scale, trust = np.zeros((codes.shape[1], 2)), np.zeros(codes.shape[1])
    for b in range(codes.shape[1]):
        x, z = np.stack([m[:, b], np.ones(len(m))]), (truth[:, b] + 1) / 2
        w = np.zeros(2)
        for _ in range(30):  # Newton steps of a logistic regression with a little ridge
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - z) + 1e-3 * w)
        scale[b] = w
        wrong = np.clip(np.mean((w @ x > 0) != (z > 0.5)), 0.002, 0.498)
        trust[b] = np.log((1 - wrong) / wrong)
    return Model(languages, codes, weights, scale, trust)


def decode(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, best first; losses; softmax shares."""
    z = m * model.scale[:, 0] + model.scale[:, 1]
    loss = np.logaddexp(0, -z[:, None, :] * model.codes[None]) @ model.trust / model.trust.sum()
    share = np.exp(-(loss - loss.min(1, keepdims=True)) * model.codes.shape[1])
    return np.argsort(loss, 1, kind="stable"), loss, share / share.sum(1, keepdims=True)


def predict(df: DataFrame, model: Model | None, text: str = "text", unsure: float = 0.8) -> DataFrame:
    """Adds lang_pred, score, lang_second and ambiguous (the best share is below ``unsure``)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_second", T.StringType()), T.StructField("ambiguous", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in parts(batch, text):
                real = [i for i, t in enumerate(part) if model and t and LETTER.search(t)]
                pred, score, second = ["und"] * len(part), np.zeros(len(part)), [None] * len(part)
                if real:
                    order, _, share = decode(model, margins(model.weights, [part[i] for i in real]))
                    for i, o, s in zip(real, order, share, strict=True):
                        pred[i], score[i] = model.languages[o[0]], s[o[0]]
                        second[i] = model.languages[o[1]] if len(o) > 1 else None
                cols = {"lang_pred": pa.array(pred), "score": pa.array(score), "lang_second": pa.array(second, pa.string()), "ambiguous": pa.array(score < unsure)}
                yield _with_columns(rows.drop_columns([text]), cols)

    return _map(df, run, fields, (text,))


def sample(docs: DataFrame, train: Column, per_language: int = 1500, longest: int = 20_000, most: int = 12_000) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language, fewer where ``most`` in all would be passed.

    That, and texts of up to ``longest`` characters, is the bound on what is learned from; with more than
    ``most`` languages the ``most`` commonest are learned. Rows are picked by the hash of what they hold,
    and equal ones count once, so a run repeated picks the same ones.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & (F.length("text") <= longest))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not n:
        return []
    each = min(per_language, most // len(n))
    part = F.create_map(*(F.lit(x) for k, c in n.items() for x in (k, min(1.0, each / c))))
    picked = rows.filter(sampled(F.coalesce(part[F.col("lang")], F.lit(0.0)), "doc_id", "text", "lang"))
    return sorted((r["text"], r["lang"]) for r in picked.select("text", "lang").distinct().collect())


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(sample(docs, rest != 2))
    out = predict(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_second", "ambiguous")
