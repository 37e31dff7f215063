"""Token counts as delta-maintained rollups.

A store is a folder with two tables of Parquet batches. ``log`` holds signed rows by document: an
insert adds one, a delete takes away what the log says the document has, a revision does both.
``deltas`` holds the sums of each batch by source, language and tokenizer version; their sum over
committed batches is the rollup, so no batch ever reads the texts of another. A batch is committed by
its folder in ``deltas`` being complete. One that failed before that is written anew from the start;
one committed is skipped, so a batch may be sent any number of times.

Texts are encoded once a batch and tokenizer; what the log holds is asked for by id alone.

Defined results: a null text has no tokens; a null source or language is a value like any other; a row
without ``doc_id`` cannot be found again, so each insert or revision of one adds a document and a delete
of one changes nothing; of several changes to one document in a batch the one of greatest ``seq`` holds, ties broken by
operation, source, language and count, greatest last; deleting an unknown document changes nothing, inserting a
known one revises it; empty batches commit; an empty store has an empty rollup; a long text is encoded whole
and takes about 30 times its bytes; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.llm import scratch
from chunkflow.llm.bpe import PATTERN, _map, _with_columns, encoder, parts, vocabulary

KEYS = ["source", "lang", "tokenizer"]
LOG = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, batch string"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` with ``tokens long``, by the byte-level vocabulary at ``path``."""
    vocab = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for part, texts in parts(batch, text):
                yield _with_columns(part.drop_columns([text]), {"tokens": pa.array(enc.counts([t or "" for t in texts]))})

    return _map(df, run, [T.StructField("tokens", T.LongType())], (text,))


class Store:
    """Rollups of one collection; ``tokenizers`` maps a tokenizer version to its vocabulary file."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str]) -> None:
        self.spark, self.path, self.tokenizers = spark, path, tokenizers

    def _batch_path(self, table: str, batch: str) -> str:
        return f"{self.path}/{table}/batch={hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def committed(self, batch: str) -> bool:
        return scratch.exists(self.spark, f"{self._batch_path('deltas', batch)}/_SUCCESS")

    def _read(self, table: str, schema: str) -> DataFrame:
        """Rows of committed batches: the marker of a batch is its folder in ``deltas``."""
        done = scratch.committed(self.spark, f"{self.path}/deltas")
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema.rpartition(",")[0]).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{f}" for f in done))

    def apply(self, changes: DataFrame, batch: str) -> bool:
        """Commits ``changes(doc_id, op, seq, source, lang, text)``; ``op`` is insert, revise or delete.

        Returns whether there was anything to do: False for a batch committed before.
        """
        if self.committed(batch):
            return False
        rows = None
        base = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "op", F.col("seq").cast("long").alias("seq"), "source", "lang", F.when(F.col("op") != "delete", F.col("text")).alias("text"))
        for name, vocab in self.tokenizers.items():
            counted = count_tokens(base, vocab).withColumn("tokenizer", F.lit(name))
            rows = counted if rows is None else rows.unionByName(counted)
        # The texts are gone by now; what is shuffled is a few numbers a document.
        nameless = F.col("doc_id").isNull()
        rows = rows.filter(~nameless | (F.col("op") != "delete")).withColumn("own", F.when(nameless, F.monotonically_increasing_id()))
        new = rows.groupBy("doc_id", "own", "tokenizer").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("c")).select("doc_id", "tokenizer", "c.*")
        signed = new.filter(F.col("op") != "delete").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        if not self.empty():
            log = self._read("log", LOG).filter(F.col("tokenizer").isin(list(self.tokenizers)))
            held = log.join(base.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            signed = signed.unionByName(held.select("doc_id", *KEYS, F.negative("docs").alias("docs"), F.negative("tokens").alias("tokens")))
            own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("own")  # no heap of rows without id
            signed = signed.groupBy("doc_id", own, *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).drop("own")
        at = self._batch_path("log", batch)
        signed.filter("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(at)
        sums = self.spark.read.schema(LOG.rpartition(",")[0]).parquet(at).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(self._batch_path("deltas", batch))
        return True

    def empty(self) -> bool:
        return not scratch.exists(self.spark, f"{self.path}/deltas")

    def rollup(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the sums of the deltas; groups without documents are left out."""
        sums = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents, after a history that ends with each as it is.

    All enter in one batch, a tenth of them under another source. The next batch deletes another tenth
    and revises the first; a third one inserts again what was deleted. Each batch is sent twice.
    """
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the vocabulary's pattern is not the one that the encoder is made for")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tenth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9))
    changes = lambda rows, op, seq, source: rows.select("doc_id", F.lit(op).alias("op"), F.lit(seq).alias("seq"), source.alias("source"), "lang", "text")
    as_is = F.col("source")
    store = Store(spark, scratch.new_path(spark, "token-counts"), {"byte_bpe_multi_50k@1": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")})
    batches = [
        ("load", changes(docs, "insert", 0, F.when(tenth == 1, F.lit("unsorted")).otherwise(as_is))),
        ("change", changes(docs.filter(tenth == 0), "delete", 1, as_is).unionByName(changes(docs.filter(tenth == 1), "revise", 1, as_is))),
        ("return", changes(docs.filter(tenth == 0), "insert", 2, as_is)),
    ]
    for name, rows in batches:
        store.apply(rows, name)
        store.apply(rows, name)  # sent again: committed before
    return store.rollup()
