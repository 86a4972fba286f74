"""Dynamic retrieval: each topic goes to phrase, proximity or single-term evidence.

A topic's phrases are looked up in order. One that the phrase index holds is
scored by BM25 on that index. For any other the terms' posting lists are
intersected, and if a document holds them all close together, or did so for an
earlier such phrase of the topic, the positional index is scored. The last
routed phrase of a topic counts. Topics with too few
documents, or without a positional hit, fall back on single terms; where both
score a document its scores are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiquarry.functions import text
from lexiquarry.functions.stops import STOP_WORDS
from lexiquarry.operators import counting
from lexiquarry.operators.index import Index, placed_postings
from lexiquarry.operators.ranking import BROADCAST_ROWS, bm25, hinted, top
from lexiquarry.operators.staging import written

WINDOW = 15


def query_phrases(topics: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """(query_id, ord, phrase): two- and three-word phrases of the titles, in order, repeats kept."""
    t = topics.select("query_id", text.phrase_tokens(text.decode_escapes(F.col("title"))).alias("t"))
    flagged = t.withColumn("ok", text.phrase_flags(F.col("t"), stops))
    return flagged.select("query_id", F.posexplode(text.phrases(F.col("t"), F.col("ok"), 2)).alias("ord", "phrase"))


def intersection(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc_id, positions): documents that hold every term of a key, positions in term order.

    ``wanted`` is (key, place, term).
    """
    wanted = written(wanted, "wanted")
    known = hinted(wanted.select("term").distinct())
    rows = written(postings.join(known, "term", "left_semi").select("term", "doc_id", "positions"), "placed")
    df = written(rows.groupBy("term").agg(F.count("*").alias("df")), "df")
    # A key is looked up by its rarest term, so that frequent terms don't meet every key they are in; one that no document has rules its keys out.
    keys = wanted.join(hinted(df), "term", "left").groupBy("key").agg(F.count("*").alias("need"), F.count("df").alias("held"), F.min(F.struct("df", "term")).alias("least"))
    keys = written(keys.filter("need = held").select("key", "need", F.col("least.term").alias("term")), "keys")
    candidates = rows.select("term", "doc_id").join(hinted(keys), "term").select("key", "need", "doc_id")
    each = candidates.join(hinted(wanted), "key").join(rows, ["term", "doc_id"])
    lists = each.groupBy("key", "need", "doc_id").agg(F.count("*").alias("have"), F.sort_array(F.collect_list(F.struct("place", "positions"))).alias("lists"))
    return lists.filter("have = need").select("key", "doc_id", F.col("lists.positions").alias("positions"))


def lists_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What ``intersection`` gives of the documents' positional postings, found within each document and without a shuffle where that can be done.

    Phrases that are too many to send with the tasks, and texts that share an id, take the postings.
    """
    wanted = written(wanted, "wanted")
    if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS or counting.repeated(docs):
        return intersection(placed_postings(docs, hinted(wanted.select("term").distinct())), wanted)
    listed: dict[str, list[str]] = {}
    for r in wanted.orderBy("key", "place").collect():  # BROADCAST_ROWS at most
        listed.setdefault(r["key"], []).append(r["term"])
    return counting.phrase_lists(docs.select("doc_id", text.tokens(F.col("text")).alias("t")), sorted(listed.items()))


def near_pairs(lists: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows whose two terms come within ``window`` positions: for two terms this is what the scan finds."""
    return lists.filter(F.exists(F.col("positions")[0], lambda a: F.exists(F.col("positions")[1], lambda b: F.abs(a - b) <= window)))


def within(lists: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows that have one position of each term with a greatest distance of ``window`` at most."""
    starts = F.flatten("positions")
    return lists.filter(F.exists(starts, lambda s: F.forall("positions", lambda p: F.exists(p, lambda x: (x >= s) & (x <= s + window)))))


def scan_hit(lists: list[list[int]], window: int = WINDOW) -> bool:
    """The sequential scan: every list moves up to the greatest position less the window, until all lie below it plus the window."""
    at = [0] * len(lists)
    while True:
        top_at = max(p[i] for p, i in zip(lists, at))
        for k, p in enumerate(lists):
            while at[k] < len(p) and p[at[k]] < top_at - window:
                at[k] += 1
            if at[k] == len(p):
                return False
        here = [p[i] for p, i in zip(lists, at)]
        if max(here) < top_at + window:
            return True


def scanned(lists: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows that the exact scan accepts; three terms make it depend on the order of moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [all(len(p) for p in x) and scan_hit([list(p) for p in x], window) for x in batch["positions"]]
            yield batch[pd.Series(keep, index=batch.index, dtype=bool)]

    return lists.mapInPandas(run, lists.schema)


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """(key, place, term) of distinct phrases; the phrase is the key."""
    return phrases.select(F.col("phrase").alias("key")).distinct().select("key", F.posexplode(F.split("key", " ")).alias("place", "term"))


def route(topics: DataFrame, phrase_index: Index, positional_index: Index, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(query_id, ord, phrase, route) of the routed phrases, and the hits per topic (query_id, hits).

    A topic's hits are counted over its phrases in order: from the first hit on, every phrase that
    the phrase index lacks goes to the positional index, if that holds all its terms.
    """
    asked = query_phrases(topics)
    listed = asked.select("phrase").distinct()
    held = phrase_index.terms.select(F.col("term").alias("phrase")).join(hinted(listed), "phrase", "left_semi").withColumn("held", F.lit(True))
    marked = written(asked.join(held, "phrase", "left"), "asked")
    known = marked.filter("held").select("query_id", "ord", "phrase", F.lit("phrase").alias("route"))
    other = marked.filter("held is null").select("query_id", "ord", "phrase")
    parts = written(phrase_terms(other), "parts")
    found = positional_index.terms.join(hinted(parts.select("term").distinct()), "term", "left_semi").select("term", F.lit(1).alias("there"))
    whole = written(parts.join(hinted(found), "term", "left").groupBy(F.col("key").alias("phrase")).agg(F.every(F.col("there").isNotNull()).alias("whole")).filter("whole").select("phrase"), "whole")
    lists = intersection(positional_index.postings, parts)
    hits = written(scanned(lists, window).groupBy(F.col("key").alias("phrase")).agg(F.count("*").alias("hits")), "hits")  # a row a phrase
    so_far = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    close = other.join(hinted(whole), "phrase").join(hinted(hits), "phrase", "left").withColumn("so_far", F.sum("hits").over(so_far)).filter("so_far > 0")
    counts = close.groupBy("query_id").agg(F.sum("hits").alias("hits"))
    routed = known.unionByName(close.select("query_id", "ord", "phrase", F.lit("positional").alias("route")))
    return written(routed, "routed"), written(counts, "counts")


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """Scores of both, averaged where both have one."""
    a = first.select("query_id", "doc_id", F.col("score").alias("a"))
    b = second.select("query_id", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("a") + F.col("b")) / 2).otherwise(F.coalesce("b", "a"))
    return both.select("query_id", "doc_id", score.alias("score"))


def rank_dynamic(topics: DataFrame, phrase_index: Index, positional_index: Index, single_index: Index, queries: DataFrame, k: int = 100, window: int = WINDOW, combine: str = "last") -> DataFrame:
    """(query_id, doc_id, rank, score). ``combine``: the last routed phrase, or the sum over all."""
    routed, counts = route(topics, phrase_index, positional_index, window)
    if combine == "last":
        last = routed.groupBy("query_id").agg(F.max_by(F.struct("ord", "phrase", "route"), "ord").alias("r"))
        routed = written(last.select("query_id", "r.ord", "r.phrase", "r.route"), "last")
    by_phrase = routed.filter("route = 'phrase'").select("query_id", F.col("phrase").alias("term"), F.lit(1).alias("qtf")).distinct()
    by_terms = routed.filter("route = 'positional'").select("query_id", F.explode(F.split("phrase", " ")).alias("term")).distinct().withColumn("qtf", F.lit(1))
    both = bm25(phrase_index, written(by_phrase, "by-phrase")).unionByName(bm25(positional_index, written(by_terms, "by-terms")))
    scores = written(both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), "scores")
    sizes = scores.groupBy("query_id").agg(F.count("*").alias("n"))
    state = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(counts, "query_id", "left")
    weak = state.filter((F.coalesce("n", F.lit(0)) < k) | (F.coalesce("hits", F.lit(0)) == 0)).select("query_id")
    asked = written(queries.join(weak, "query_id", "left_semi").withColumn("qtf", F.lit(1)), "weak")
    single = written(bm25(single_index, asked), "single")
    return top(fuse(scores, single), k)
