"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first four, five and six bytes (for inflected
forms), hashed and counted once a text. Besides a weight, each term has a vector of factors; the dot products of the
vectors of all pairs of terms in a text learn interactions that additive weights miss.

Defined results: a null or empty text has no terms and gets the score of the intercept; a row gives a
row, so null and repeated ids are kept; labels that are null are not learned from, and an id labelled
twice counts as toxic if either label says so; with no labels of one class the score is that of the
known share; a long text is hashed in pieces and takes about eight times its bytes; further columns are kept,
one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.llm.bpe import _map, _with_columns, chunks, parts
from chunkflow.llm.scratch import collect_garbage, sampled
from chunkflow.llm.words import PUNCTUATION, Words, distinct

BITS, FACTORS, STEMS = 20, 8, (4, 5, 6)
#: Terms whose pairs are screened, the most common ones, and the share of texts that each must be in.
PAIRED, PAIRED_SHARE = 2048, 0.01


@dataclass
class Model:
    intercept: float
    weight: np.ndarray  # 2^BITS, float32
    row: np.ndarray  # 2^BITS, int32: the term's row in ``factor``, or -1
    factor: np.ndarray  # rows x FACTORS, float32


def terms(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with ``used``, a flag by bucket, of those buckets only."""
    w = Words(texts, PUNCTUATION, STEMS)
    text, bucket = [], []
    for j in range(-1, len(STEMS)):
        some = np.arange(len(w.hashes)) if j < 0 else np.flatnonzero(w.stems[:, j])
        b = ((w.hashes if j < 0 else w.stems[some, j]) >> np.uint64(64 - BITS)).astype(np.int64)
        if used is not None:
            known = used[b]
            some, b = some[known], b[known]
        text.append(w.text[some])
        bucket.append(b)
    return distinct(np.concatenate(text), np.concatenate(bucket))


def _sums(model: Model, n: int, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    row = model.row[bucket]
    out = model.intercept + np.bincount(text, model.weight[bucket], n)
    v = model.factor[row]
    for f in range(FACTORS):
        s = np.bincount(text, v[:, f], n)
        out += 0.5 * (s * s - np.bincount(text, v[:, f].astype(float) ** 2, n))
    return out


def probability(model: Model, texts: list[str | None]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_sums(model, len(texts), *terms(texts, model.row >= 0)), -30, 30)))


def interacting(text: np.ndarray, term: np.ndarray, toxic: np.ndarray, n_terms: int, least_z: float) -> np.ndarray:
    """Flags of terms in a pair that says more than both do by themselves.

    Of the four groups of texts with both, either and neither, the shares of toxic ones add up if there is
    no interaction: share(both) - share(one) - share(other) + share(neither) is 0. A pair counts where that
    is ``least_z`` standard errors off. Screened are the ``PAIRED`` most common terms in at least
    ``PAIRED_SHARE`` of the texts and at most as many less.
    """
    n, out = len(toxic), np.zeros(n_terms, bool)
    df = np.bincount(term, minlength=n_terms)
    some = np.flatnonzero((df >= max(5, PAIRED_SHARE * n)) & (df <= (1 - PAIRED_SHARE) * n))
    some = some[np.argsort(-df[some], kind="stable")[:PAIRED]]
    place = np.full(n_terms, -1)
    place[some] = np.arange(len(some))
    keep = place[term] >= 0
    text, col = text[keep], place[term[keep]]
    all_, bad = (np.zeros((len(some), len(some)), np.float32) for _ in range(2))
    edges = np.searchsorted(text, np.arange(0, n + 512, 512))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):  # texts in blocks
        x = np.zeros((min(512, n - 512 * k), len(some)), np.float32)
        x[text[a:b] - 512 * k, col[a:b]] = 1
        all_ += x.T @ x
        x = x[toxic[512 * k : 512 * k + len(x)] > 0]
        bad += x.T @ x
    n1, total, wrong = toxic.sum(), np.diag(all_), np.diag(bad)
    for i in range(len(some)):
        both, one, other = all_[i], total[i] - all_[i], total - all_[i]
        cells = [(both, bad[i]), (one, wrong[i] - bad[i]), (other, wrong - bad[i]), (n - both - one - other, n1 - wrong[i] - wrong + bad[i])]
        share = [(b + 0.5) / (m + 1) for m, b in cells]
        off = share[0] - share[1] - share[2] + share[3]
        z = np.abs(off) / np.sqrt(sum(p * (1 - p) / (m + 1) for p, (m, _) in zip(share, cells, strict=True)))
        hit = (z >= least_z) & np.logical_and.reduce([m >= 5 for m, _ in cells])
        hit[i] = False
        if hit.any():
            out[some[i]] = out[some[hit]] = True
    return out


def fit(texts: list[str], toxic: np.ndarray, prior: float, epochs: int = 40, batch: int = 128, rate: float = 0.3, least: int = 4, least_z: float = 4.0, decay: float = 1e-5, seed: int = 7, least_pair_z: float = 6.0) -> Model:
    """Minimises logistic loss by AdaGrad.

    Terms in fewer than ``least`` texts are left out. The others are learned if their share of toxic texts
    differs from their share of others by ``least_z`` standard errors, or if they are in a pair that
    interacts (``interacting``), though neither says anything alone; more would only be learned by heart.

    ``prior`` is the share of toxic texts where the model is used; the intercept is moved from the
    share in the sample to it.
    """
    model = Model(float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (15.0 if prior >= 1 else -15.0), np.zeros(1 << BITS, np.float32), np.full(1 << BITS, -1, np.int32), np.zeros((0, FACTORS), np.float32))
    if not 0 < toxic.mean() < 1 if len(toxic) else True:
        return model
    found = []
    for a, b in chunks(texts):
        t, k = terms(texts[a:b])
        found.append((np.int32(a) + t.astype(np.int32), k.astype(np.int32)))
    text, bucket = (np.concatenate(c) for c in zip(*found, strict=True))
    del found
    ids, term = np.unique(bucket, return_inverse=True)
    term = term.astype(np.int32)
    both, bad = np.bincount(term), np.bincount(term, toxic[text], len(ids))
    n1, n = toxic.sum(), len(toxic)
    share = np.clip(both / n, 1 / n, 1 - 1 / n)
    z = (bad / n1 - (both - bad) / (n - n1)) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)))
    used = ids[(both >= least) & ((np.abs(z) >= least_z) | interacting(text, term, toxic, len(ids), least_pair_z))]
    model.row[used] = np.arange(len(used))
    keep = model.row[bucket] >= 0
    text, row = text[keep], model.row[bucket[keep]]
    del bucket, term, keep
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS)), float(np.log(toxic.mean() / (1 - toxic.mean())))
    gw, gv, gb = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            n = first[docs + 1] - first[docs]
            ends = np.cumsum(n)
            rows = row[np.arange(ends[-1]) + np.repeat(first[docs] - (ends - n), n)]
            own = np.repeat(np.arange(len(docs)), n)
            vr = v[rows]
            s = np.stack([np.bincount(own, vr[:, f], len(docs)) for f in range(FACTORS)], 1)
            q = np.bincount(own, (vr * vr).sum(1), len(docs))
            z = b + np.bincount(own, w[rows], len(docs)) + 0.5 * ((s * s).sum(1) - q)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[docs]
            e = err[own]
            ids, inv = np.unique(rows, return_inverse=True)
            dw = np.bincount(inv, e) / len(docs) + decay * w[ids]
            each = e[:, None] * (s[own] - vr)
            dv = np.stack([np.bincount(inv, each[:, f]) for f in range(FACTORS)], 1) / len(docs) + decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
            gb += err.mean() ** 2
            b -= rate * err.mean() / gb**0.5
    if 0 < prior < 1:
        b += np.log(prior / (1 - prior)) - np.log(toxic.mean() / (1 - toxic.mean()))
    model.intercept, model.factor = float(b), v.astype(np.float32)
    model.weight[used] = w
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds ``score double``, the chance that a text is toxic, and ``predicted int``."""
    used = np.flatnonzero(model.row >= 0)
    sent = (model.intercept, used, model.weight[used], model.factor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intercept, ids, weight, factor = sent
        own = Model(intercept, np.zeros(1 << BITS, np.float32), np.full(1 << BITS, -1, np.int32), factor)
        own.weight[ids], own.row[ids] = weight, np.arange(len(ids))
        for batch in batches:
            for part, texts in parts(batch, text):
                p = probability(own, texts)
                rest = part if keep_text else part.drop_columns([text])
                yield _with_columns(rest, {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return _map(df, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], () if keep_text else (text,))


def train(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = 4000, longest: int = 20_000) -> Model:
    """Learns from about ``per_class`` labelled texts of each class, of up to ``longest`` characters.

    That is the bound on what is learned from. Rows are picked by the hash of their id, and equal texts
    of one class count once. ``use`` says which labels may be learned from.
    """
    known = labels.filter(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    n = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if not total:
        return fit([], np.zeros(0), 0.0)
    part = F.when(F.col("_toxic") == 1, F.lit(per_class / n.get(1, 1))).otherwise(F.lit(per_class / n.get(0, 1)))
    picked = known.filter(sampled(part, "doc_id"))  # about 2 * per_class ids
    rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(picked), "doc_id").select("text", "_toxic").distinct().collect()
    rows.sort(key=lambda r: (r["text"], r["_toxic"]))
    model = fit([r["text"] for r in rows], np.array([r["_toxic"] for r in rows], float), n.get(1, 0) / total)
    del rows
    collect_garbage(docs.sparkSession)
    return model


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, labels, rest != 0)
    return predict(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"), model)
