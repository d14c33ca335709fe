"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, htmltext, langid, lm, packing, phrases, quality, secrets, simhash, spm


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fingerprints": lambda s, d: fingerprint.fingerprints(_docs(s, d)),
        "op2_quality_rules": lambda s, d: quality.judge(_docs(s, d)),
        "op3_language_id": lambda s, d: langid.identify(_docs(s, d)),
        "op4_simhash_near_dedup": lambda s, d: simhash.duplicates(_docs(s, d)),
        "op5_packing": lambda s, d: packing.pack(_docs(s, d)),
        "op6_secret_scan": lambda s, d: secrets.scan(_docs(s, d)),
        "op7_substring_dedup": lambda s, d: phrases.passages(_docs(s, d)),
        "op8_sentencepiece": lambda s, d: spm.encode(_docs(s, d)),
        "op9_html_extraction": lambda s, d: htmltext.extract(s.read.parquet(f"{d}/pages.parquet")),
        "op10_lm_scores": lambda s, d: lm.score(_docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_fingerprints": fingerprint.oracle(),
        "op2_quality_rules": quality.oracle(),
        "op5_packing": packing.oracle(),
    }
