"""Writers: indexes as Parquet or text, lexicons, runs, vectors and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.operators.index import Index, lexicon, nested


def posting_line() -> Column:
    """``term -> [['doc', 'tf'], ...]`` of a nested row."""
    pairs = F.transform("postings", lambda p: F.concat(F.lit("['"), p["doc_id"].cast("string"), F.lit("', '"), p["tf"].cast("string"), F.lit("']")))
    return F.concat("term", F.lit(" -> ["), F.array_join(pairs, ", "), F.lit("]"))


def write_index(index: Index, path: str, kind: str, mode: str = "overwrite") -> None:
    """Postings sorted by term within range partitions, so a reader's filter on terms skips files."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/{kind}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/{kind}/terms")
    index.doc_stats.write.mode(mode).parquet(f"{path}/{kind}/doc_stats")


def load_index(spark, path: str, kind: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{kind}/{t}") for t in ("postings", "terms", "doc_stats")))


def write_posting_text(postings: DataFrame, path: str) -> None:
    nested(postings).orderBy("term").select(posting_line().alias("value")).write.mode("overwrite").text(path)


def write_lexicon(postings: DataFrame, path: str) -> None:
    lexicon(postings).select(F.col("term").alias("value")).write.mode("overwrite").text(path)


def run_lines(run: DataFrame, tag: str, doc: str = "doc_id") -> DataFrame:
    """``qid 0 doc rank score TAG`` lines."""
    return run.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col(doc).cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str, mode: str = "overwrite") -> None:
    run_lines(run.orderBy("query_id", "rank"), tag).write.mode(mode).text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
