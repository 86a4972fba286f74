"""Evaluation of runs (query_id, doc_id, rank) against judgements (query_id, doc_id, rel).

Means run over the topics that have a relevant document; a topic with no result counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiquarry.operators.ranking import hinted

#: Characters of the pieces by which titles without an inner word are looked up.
PIECE = 4


def containing(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel): documents whose text contains a topic's title; empty titles give none.

    Cut at blanks, the words between a title's first and last stand whole in every text that
    contains it: titles are looked up by the rarest of these. Titles without such a word are
    looked up by their first characters among all pieces of the texts. Hits are then compared.
    """
    wanted = topics.select("query_id", "title").filter("title <> ''")
    split = F.split("title", " ")
    inner = F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != "")
    keyed = wanted.withColumn("inner", inner)
    words = keyed.select("query_id", "title", F.explode(F.array_distinct("inner")).alias("key"))
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    known = held.join(hinted(words.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
    counted = words.join(known, "key", "left").groupBy("query_id", "title").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("least"))
    hits = held.join(hinted(counted.select("query_id", "title", F.col("least.key").alias("key"))), "key").select("doc_id", "query_id", "title")
    short = keyed.filter(F.size("inner") == 0).select("query_id", "title", F.substring("title", 1, PIECE).alias("key"))
    sizes = sorted(r[0] for r in short.select(F.length("key")).distinct().collect())  # PIECE rows at most
    if sizes:
        cuts = F.array(*[F.lit(n) for n in sizes])
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.transform(cuts, lambda n: F.substring(F.col("text"), i, n))))
        cut = docs.filter("text <> ''").select("doc_id", F.explode(F.array_distinct(pieces)).alias("key"))
        hits = hits.unionByName(cut.join(hinted(short), "key").select("doc_id", "query_id", "title"))
    compared = docs.select("doc_id", "text").join(hits, "doc_id").filter(F.contains("text", "title"))
    return compared.select("query_id", "doc_id", F.lit(1).alias("rel")).distinct()


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ``rel`` (0 where there is no judgement) and ``found``, the relevant so far."""
    good = qrels.filter("rel > 0").select("query_id", "doc_id", F.lit(1).alias("hit"))
    marked = run.join(good, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("hit", F.lit(0))).drop("hit")
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("found", F.sum("rel").over(so_far))


def measures(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per topic: n_rel, precision_at_k, recall_at_k, average_precision, reciprocal_rank, r_precision."""
    total = qrels.filter("rel > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    rows = judged(run, qrels).join(total, "query_id")
    own = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") < k, F.col("rel")).otherwise(0)).alias("at_k"),
        F.sum(F.when(F.col("rel") == 1, F.col("found") / (F.col("rank") + 1)).otherwise(0.0)).alias("precisions"),
        F.min(F.when(F.col("rel") == 1, F.col("rank") + 1)).alias("first"),
        F.sum(F.when(F.col("rank") < F.col("n_rel"), F.col("rel")).otherwise(0)).alias("at_r"),
    )
    joined = total.join(own, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "query_id",
        "n_rel",
        zero(F.col("at_k") / k).alias("precision_at_k"),
        zero(F.col("at_k") / F.col("n_rel")).alias("recall_at_k"),
        zero(F.col("precisions") / F.col("n_rel")).alias("average_precision"),
        zero(1 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("at_r") / F.col("n_rel")).alias("r_precision"),
    )


def summary(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: the means over all judged topics."""
    m = measures(run, qrels, k)
    names = ["precision_at_k", "recall_at_k", "average_precision", "reciprocal_rank", "r_precision"]
    return m.agg(F.count("*").alias("n_topics"), *[F.avg(c).alias("mean_" + c) for c in names])
