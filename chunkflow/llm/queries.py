"""Queries of the subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkflow.llm import bpe, decontam, flatgraph, langid, minhash, pii, secrets, suffixdedup, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_langid": langid.op2_langid,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_flat_graph": flatgraph.op9_flat_graph,
    "op10_near_duplicates": minhash.op10_near_duplicates,
}
ORACLE_SQL: dict[str, str] = {
    "op1_secrets": secrets.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op8_suffix_dedup": suffixdedup.ORACLE_SQL,
    "op9_flat_graph": flatgraph.ORACLE_SQL,
    "op10_near_duplicates": minhash.ORACLE_SQL,
}
