"""The queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import fingerprints, hilbert_ann, language_id, line_dedup, mixing, secret_scan, sentencepiece_wfst, sharding, simhash, substring_dedup
from gleanery.llm.common import table

_DOCUMENTS = {
    "op1_secret_scan": secret_scan.digest,
    "op2_sentencepiece": sentencepiece_wfst.digest,
    "op3_line_dedup": line_dedup.digest,
    "op4_simhash": simhash.digest,
    "op5_substring_dedup": substring_dedup.digest,
    "op6_language_id": language_id.digest,
    "op7_sharding": sharding.digest,
    "op8_fingerprints": fingerprints.digest,
    "op9_mixing": mixing.digest,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, f=f: f(table(spark, sf_dir, "documents"))) for name, f in _DOCUMENTS.items()}
    out["op10_hilbert_ann"] = lambda spark, sf_dir: hilbert_ann.digest(table(spark, sf_dir, "embeddings"))
    return out


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op5_substring_dedup": substring_dedup.SQL, "op9_mixing": mixing.SQL}
