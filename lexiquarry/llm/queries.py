"""One query per operator, each over its whole tables, with the oracles SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import ann, decontaminate, extract, linededup, mixing, pii, quality, simhash, substring, toxicity
from lexiquarry.llm.common import table

#: The query's key where the session names none: test tables hold no real data. ``pii.replace`` itself has no default.
DEMONSTRATION_KEY = "demonstration"


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), page_id="page_id", url="url")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "removed_lines", "text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "cut_bytes", F.size("spans").alias("n_spans"), (F.size("spans") > 0).alias("repeats"), "text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.lexiquarry.surrogate.key", DEMONSTRATION_KEY)
    return pii.replace(table(spark, sf_dir, "documents", "doc_id", "text"), key).select("doc_id", "n_mentions", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_extract, op2_line_dedup, op3_simhash, op4_mix, op5_ann, op6_substring, op7_pii, op8_quality, op9_toxicity, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": decontaminate.ORACLE}
