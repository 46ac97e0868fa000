"""The corpus operators as queries over whole tables, with production parameters; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tolera.llm import ann, bpe, katz, license, packing, quality, rules, simhash, substring, suffix
from tolera.llm.common import table


def _documents(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


def _op5(docs: DataFrame) -> DataFrame:
    return rules.judge(docs).select("doc_id", *rules.COUNTS, "base_failed", "kept", "quality")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _documents(simhash.groups),
        "op2_katz": _documents(katz.score),
        "op3_suffix_dedup": _documents(suffix.digest),
        "op4_packing": _documents(lambda docs: packing.pack(docs, added=True)),
        "op5_quality_rules": _documents(_op5),
        "op6_quality_classifier": op6,
        "op7_substring_dedup": _documents(substring.digest),
        "op8_license_scan": _documents(license.digest),
        "op9_bpe": _documents(bpe.digest),
        "op10_ann": op10,
    }


def oracle_sql() -> dict[str, str]:
    """None of the ten results as a whole: fingerprints by a seeded hash, fitted models, tokenisers, packing, searches.  (The
    base columns of op5 and op8 could be said in SQL, but the models' verdicts stand beside them.)  tests/llm holds each
    against a brute-force version."""
    return {}
