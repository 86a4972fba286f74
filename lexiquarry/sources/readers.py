"""Readers for SGML collections, topics, judgements, stop lists and stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QRELS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("iter", T.IntegerType()), T.StructField("doc_id", T.StringType()), T.StructField("rel", T.IntegerType())])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): one row per file."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def element(value: Column, tag: str) -> Column:
    return F.regexp_extract(value, rf"(?is)<{tag}>(.*?)</{tag}>", 1)


def strip_markup(value: Column) -> Column:
    """Text of the descendants: comments and tags go."""
    return F.regexp_replace(F.regexp_replace(value, "(?s)<!--.*?-->", ""), "<[^>]+>", "")


def split_documents(files: DataFrame, value: str = "value") -> DataFrame:
    """(doc_id, parent, text) of every DOC element."""
    each = files.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(r"(?is)<doc>(.*?)</doc>"), F.lit(1))).alias("d"))
    texts = F.array_join(F.regexp_extract_all("d", F.lit(r"(?is)<text>(.*?)</text>"), F.lit(1)), "")
    return each.select(F.trim(strip_markup(element(F.col("d"), "docno"))).alias("doc_id"), F.trim(strip_markup(element(F.col("d"), "parent"))).alias("parent"), strip_markup(texts).alias("text"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return split_documents(whole_files(spark, path))


def split_topics(files: DataFrame, value: str = "value") -> DataFrame:
    """(query_id, title, description, narrative) of every top element."""
    each = files.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(r"(?is)<top>(.*?)</top>"), F.lit(1))).alias("t"))
    line = lambda tag, label: F.trim(F.regexp_extract("t", rf"(?i)<{tag}>\s*{label}:?[ \t]*([^\r\n<]*)", 1))
    block = lambda tag, label: F.trim(F.regexp_extract("t", rf"(?is)<{tag}>\s*{label}:?\s*(.*?)\s*(?:<|\z)", 1))
    return each.select(line("num", "Number").alias("query_id"), line("title", "Topic").alias("title"), block("desc", "Description").alias("description"), block("narr", "Narrative").alias("narrative"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return split_topics(whole_files(spark, path))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=QRELS)


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One word per line; the list is small by nature and goes into expressions."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct().orderBy("w").limit(100_000).collect()
    return tuple(r["w"] for r in rows)


def read_weighted_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, idf, cf, doc_id, tf) of text lines ``term TAB df idf cf TAB [['doc', 'tf'], ...]``."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 3)
    stats = F.split(F.get("p", F.lit(1)), " ")
    rows = parts.select(F.get("p", F.lit(0)).alias("term"), F.get(stats, F.lit(0)).cast("long").alias("df"), F.get(stats, F.lit(1)).cast("double").alias("idf"), F.get(stats, F.lit(2)).cast("long").alias("cf"), F.from_json(F.replace(F.get("p", F.lit(2)), F.lit("'"), F.lit('"')), "array<array<string>>").alias("list"))
    each = rows.select("term", "df", "idf", "cf", F.explode("list").alias("e"))
    return each.select("term", "df", "idf", "cf", F.get("e", F.lit(0)).alias("doc_id"), F.get("e", F.lit(1)).cast("long").alias("tf"))


def read_doc_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_len, doc_norm2) of text lines ``doc tf tf_idf``."""
    return spark.read.csv(path, sep=" ", schema="doc_id string, doc_len long, doc_norm2 double")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="query_id string, iter int, doc_id string, rank int, score double, tag string")
