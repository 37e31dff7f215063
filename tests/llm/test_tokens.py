"""Byte-level BPE against the tiktoken library; rollups against plain sums."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkflow.llm import bpe, scratch, tokencount

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "２", "!", "¿", " ", "　", "中", "😀", "'d", "x", "\0", "\x1c", "́", "re", "\r\n", "<|endoftext|>"]


def ours(texts):
    enc = bpe.encoder(bpe.vocabulary(PATH))
    ids, per = enc.encode(texts)
    out, at = [], 0
    for n in per.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=5))
def test_ids_are_those_of_the_library(texts):
    assert ours(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_pieces_and_every_script():
    rng = random.Random(3)
    texts = ["a" * 20_000, " " * 5000, "ab1" * 4000, "'s" * 500, "".join(rng.choices("abcdefgh", k=3000)), "".join(chr(c) for c in range(0x20, 0xD800, 7))]
    assert ours(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_every_code_point_in_every_context():
    """Letters, numbers, symbols and blanks around each of the 1,112,064 code points."""
    assert P.PATTERN == bpe.PATTERN
    for a in range(0, 0x110000, 1 << 16):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c} a{c} '{c}s" for c in map(chr, range(a, a + (1 << 16))) if not 0xD800 <= ord(c) < 0xE000)
        assert ours([text]) == [THEIRS.encode_ordinary(text)], hex(a)


def test_scan_is_the_running_product():
    import numpy as np

    _, product, _, _ = bpe._monoid()
    f = np.random.default_rng(0).integers(0, len(product), 5000).astype(np.uint8)
    want, state = [], 0
    for x in f:
        state = product[state, x]
        want.append(state)
    assert bpe.scan_states(f).tolist() == want


def test_round_trip_and_edges(spark):
    rows = [(1, None), (2, ""), (None, "hé it's"), (2, "x" * 100_000), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit("clash"))
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(back) == 5 and all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert all(list(r.token_starts) == [len(b"".join(bytes([*THEIRS.decode_single_token_bytes(t)]) for t in r.token_ids[:k])) for k in range(len(r.token_ids))] for r in back if len(r.token_ids) < 50)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    wrong = spark.createDataFrame([([71, 526], [0, 9])], "token_ids array<int>, token_starts array<int>")
    with pytest.raises(Exception, match="offsets"):
        bpe.decode(wrong, PATH).collect()


CHANGES = "doc_id long, op string, seq int, source string, lang string, text string"


def test_rollups_follow_inserts_revisions_deletes_and_replays(spark):
    store = tokencount.Store(spark, scratch.new_path(spark, "test-store"), {"a@1": PATH, "b@1": P.path("byte_bpe_50k.tiktoken")})
    rng, state, batches = random.Random(5), {}, []
    for b in range(3):
        rows = []
        for i in rng.sample([*range(12), None], 8):
            op = rng.choice(["insert", "revise", "delete"])
            rows.append((i, op, 1, rng.choice(["s", None]), rng.choice(["en", "de"]), rng.choice([None, "hello world", "a b c d"])))
            if i is not None:
                rows.append((i, "insert", 0, "old", "xx", "must not count"))
        batches.append(rows)
        for i, op, seq, s, lang, t in rows:
            if seq:
                state.pop(i, None)
                if op != "delete":
                    state[i if i is not None else f"nameless {b}"] = (s, lang, t or "")
        assert store.apply(spark.createDataFrame(rows, CHANGES), f"b{b}")
        assert not store.apply(spark.createDataFrame(rows, CHANGES), f"b{b}")
        want = {}
        for s, lang, t in state.values():
            for name, path in store.tokenizers.items():
                n, k = want.get((s, lang, name), (0, 0))
                want[s, lang, name] = n + 1, k + len(bpe.encoder(bpe.vocabulary(path)).encode([t])[0])
        assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.rollup().collect()} == want


def test_a_failed_batch_is_written_anew(spark):
    store = tokencount.Store(spark, scratch.new_path(spark, "test-store"), {"a@1": PATH})
    rows = spark.createDataFrame([(1, "insert", 0, "s", "en", "hello")], CHANGES)
    assert store.rollup().count() == 0 and store.apply(rows.limit(0), "none") and store.rollup().count() == 0
    rows.select("doc_id").write.parquet(store._batch_path("log", "b"))  # what a crash before the commit leaves
    assert store.apply(rows, "b") and store.rollup().first().n_docs == 1


def test_rows_without_id_each_count(spark):
    store = tokencount.Store(spark, scratch.new_path(spark, "test-store"), {"a@1": PATH})
    rows = spark.createDataFrame([(None, "insert", 0, "s", "en", "hello")] * 3 + [(None, "delete", 1, "s", "en", None), (1, "insert", 0, "s", "en", None)], CHANGES)
    assert store.apply(rows, "a") and store.apply(rows, "b")
    assert (store.rollup().first().n_docs, store.rollup().first().n_tokens) == (7, 6 * len(THEIRS.encode_ordinary("hello")))


def test_the_query_counts_every_document_as_it_is(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, k = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = n + 1, k + len(THEIRS.encode_ordinary(r.text or ""))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in tokencount.op4_token_counts(spark, sf).collect()} == want
