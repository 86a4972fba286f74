"""Incremental postings: new document files are tokenised as they arrive and appended.

Document frequencies and N change with every file, so weights aren't stored:
they are computed from the appended counts when the index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from lexiquarry.operators.index import Index, from_postings, plain_postings


def append_postings(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """A query that tokenises each new Parquet file of ``source`` once and appends to ``sink``."""

    def add(batch: DataFrame, epoch: int) -> None:
        plain_postings(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # a repeated epoch replaces itself

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, sink: str) -> Index:
    return from_postings(spark.read.parquet(sink).select("term", "doc_id", "tf"))
