"""A corpus pipeline of five operators: each stage works on what its predecessor kept.

Rejected documents go at the first two stages, one document of each near-duplicate group stays at the third, repeated
passages go at the fourth (a document of which nothing is left goes too), and the last packs what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tolera.llm import packing, quality, rules, simhash, substring
from tolera.llm.common import table
from tolera.llm.graph import hub_join, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs.select(*COLUMNS))


def _row() -> Column:
    """A hash of all that a row holds: rows with the same one are equal."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of the smallest doc_id (null comes last), of several the one of least hash."""
    docs = docs.select(*COLUMNS)
    rows = simhash.rooted(docs, _row(), words=5, similarity=0.8).groupBy("row").agg(F.min("root").alias("root"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = settle(rows)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("best"), F.count("*").alias("_n"))
    marks = settle(hub_join(rows, best, "root", rows.count()).select(F.col("row").alias("_row"), (F.col("row") != F.col("best")).alias("_gone"), "n").where("_gone or n > 1"))
    named = docs.withColumn("_row", _row())
    once = named.join(marks.select("_row"), "_row", "left_anti").select(*COLUMNS)
    repeated = named.join(marks.where("not _gone").select("_row"), "_row", "left_semi").select(*COLUMNS).dropDuplicates()
    return once.unionByName(repeated)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing stay as they are; the others become their kept words, joined by a space.

    Verdicts follow from doc_id and text, and come back by both (a null id is an id here), so rows that share only one
    of them keep apart."""
    same = (F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"))
    keys = ["_none", "_id", "_place"]
    left = substring.removed(docs).where("n_removed > 0").select(*same, F.col("place").alias("_place"), F.col("text").alias("_text"), (F.col("n_words") == F.col("n_removed")).alias("_gone"))
    left = settle(left.dropDuplicates(keys))
    named = docs.select(*COLUMNS, *same, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_place"))
    joined = named.join(left, keys, "left").where("not coalesce(_gone, false)")
    return joined.select("doc_id", F.coalesce("_text", "text").alias("text"), "lang", "source", F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("_text")).cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, added=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the kept documents are settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs


#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None
