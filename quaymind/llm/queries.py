"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymind.llm import (bpe, codes, fingerprints, html_text, mixing, pii, preferences, quality, ranked, secrets, sharding,
                          simhash, topk)
from quaymind.llm.common import read_table


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(read_table(spark, sf_dir, table))
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": _over("documents", sharding.op1_sharding),
    "op2_preferences": _over("conversations", preferences.op2_preferences),
    "op3_html": _over("pages", html_text.op3_html),
    "op4_pii": _over("documents", pii.op4_pii),
    "op5_simhash": _over("documents", simhash.op5_simhash),
    "op6_quality": _over("documents", quality.op6_quality),
    "op7_bpe": _over("documents", bpe.op7_bpe),
    "op8_mixing": _over("documents", mixing.op8_mixing),
    "op9_secrets": _over("documents", secrets.op9_secrets),
    "op10_topk": _over("embeddings", topk.op10_topk),
    "op11_fingerprints": _over("documents", fingerprints.op11_fingerprints),
    "op12_ranked": ranked.op12_ranked,
    "op13_codes": _over("embeddings", codes.op13_codes),
}

ORACLES: dict[str, str] = {
    "op2_preferences": preferences.ORACLE,
    "op6_quality": quality.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_topk": topk.ORACLE,
    "op12_ranked": ranked.ORACLE,
    "op13_codes": codes.ORACLE,
}
