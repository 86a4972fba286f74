"""Document and query vectors over selected dimensions, as sparse rows or dense arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiquarry.operators.index import Index
from lexiquarry.operators.ranking import hinted


def select_dimensions(terms: DataFrame, n: int, least_idf: float = 1.0, queries: DataFrame | None = None) -> DataFrame:
    """(dim, term, idf): the n terms of lowest idf from ``least_idf`` on, in term order from 0.

    Terms of ``queries`` that are in the index come after them, in term order.
    """
    chosen = terms.filter(F.col("idf") >= least_idf).orderBy("idf", "term").limit(n).select("term", "idf").withColumn("extra", F.lit(0))
    if queries is not None:
        asked = terms.join(hinted(queries.select("term").distinct()), "term", "left_semi").select("term", "idf")
        chosen = chosen.unionByName(asked.join(chosen.select("term"), "term", "left_anti").withColumn("extra", F.lit(1)))
    # the selection has at most n rows and the query terms, so its numbering is one small task
    order = Window.orderBy("extra", "term")
    return chosen.select((F.row_number().over(order) - 1).alias("dim"), "term", "idf")


def doc_vectors(index: Index, dimensions: DataFrame) -> DataFrame:
    """(doc_id, dim, weight) with weight tf * idf."""
    return index.postings.join(hinted(dimensions), "term").select("doc_id", "dim", (F.col("tf") * F.col("idf")).alias("weight"))


def query_vectors(queries: DataFrame, dimensions: DataFrame) -> DataFrame:
    return queries.join(hinted(dimensions), "term").select("query_id", "dim", (F.col("qtf") * F.col("idf")).alias("weight"))


def dense(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """(key, vec): arrays of ``size`` doubles, zero where a vector has no weight."""
    entries = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    return entries.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vec"))
