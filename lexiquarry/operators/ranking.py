"""Ranking of all topics in one job: cosine, BM25, Dirichlet-smoothed likelihood.

Scores are rounded before they are ordered, ties go to the smaller doc_id, ranks
start at 0. A query is a row: no plan loops over queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiquarry.functions import special, text
from lexiquarry.functions.stemmer import stemmed
from lexiquarry.functions.stops import STOP_WORDS
from lexiquarry.operators.index import Index, collection_stats, term_rows
from lexiquarry.operators.staging import written

DIGITS = 6
#: Rows up to which topic terms are broadcast.
BROADCAST_ROWS = 200_000


def hinted(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where a count shows the frame within ``rows``; else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def topic_terms(topics: DataFrame, stops=STOP_WORDS, kind: str = "plain") -> DataFrame:
    """(query_id, term, qtf) of (query_id, title); topics without terms give no rows.

    Titles are parsed as the texts of an index of that kind: ``single`` takes special
    tokens first, ``positional`` keeps stop words, ``stem`` stems what is left.
    """
    if kind == "plain":
        found = topics.select("query_id", text.terms(F.col("title"), stops).alias("t"))
    elif kind in ("single", "positional", "stem"):
        decoded = topics.select("query_id", text.decode_escapes(F.col("title")).alias("line"))
        if kind == "single":
            found = special.with_special(decoded).select("query_id", F.concat("special", text.terms(F.col("rest"), stops)).alias("t"))
        else:
            found = decoded.select("query_id", (text.tokens(F.col("line")) if kind == "positional" else text.terms(F.col("line"), stops)).alias("t"))
    else:
        raise ValueError(f"topics aren't parsed into terms for an index of kind {kind!r}")
    rows = found.select("query_id", F.explode("t").alias("term")).filter("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    if kind == "stem":
        stems = stemmed(rows.select("term", F.col("query_id").alias("doc_id"), F.col("qtf").alias("tf")))
        rows = stems.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    return rows


def top(scores: DataFrame, k: int = 100, digits: int = DIGITS) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best of each query."""
    rounded = scores.select("query_id", "doc_id", F.round("score", digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", (F.col("rank") - 1).alias("rank"), "score")


def bm25_weight(n: Column, df: Column, tf: Column, qtf: Column, dl: Column, avg: Column, k1: float = 1.2, k2: float = 700.0, b: float = 0.75) -> Column:
    """May be negative for terms in over half the documents: there is no floor."""
    rarity = F.log((n - df + 0.5) / (df + 0.5))
    return rarity * ((k1 + 1) * tf / (k1 * ((1 - b) + b * dl / avg) + tf)) * ((k2 + 1) * qtf / (k2 + qtf))


def matched(index: Index, queries: DataFrame) -> DataFrame:
    """Query terms with their postings and statistics."""
    known = hinted(queries)
    return index.postings.select("term", "doc_id", "tf").join(known, "term").join(hinted(index.terms.join(known.select("term").distinct(), "term", "left_semi")), "term")


def collection_row(index: Index) -> list[Column]:
    """The collection's one row of counts as literals."""
    row = index.collection().first()
    return [F.lit(row["n_docs"]), F.lit(row["n_tokens"] or 0), F.lit(row["avg_len"])]


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    n_docs, _, avg_len = collection_row(index)
    rows = matched(index, queries).join(index.lengths, "doc_id")
    weight = bm25_weight(n_docs, F.col("df"), F.col("tf"), F.col("qtf"), F.col("doc_len"), avg_len)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def cosine(index: Index, queries: DataFrame) -> DataFrame:
    rows = matched(index, queries)
    dots = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")).alias("dot"))
    norms = queries.join(index.terms.select("term", "idf"), "term").groupBy("query_id").agg(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2)).alias("query_norm2"))
    scored = dots.join(hinted(norms), "query_id").join(index.doc_stats.select("doc_id", "doc_norm2"), "doc_id")
    length = F.sqrt(F.col("doc_norm2") * F.col("query_norm2"))
    return scored.filter((F.col("doc_norm2") > 0) & (F.col("query_norm2") > 0)).select("query_id", "doc_id", (F.col("dot") / length).alias("score"))


def likelihood(index: Index, queries: DataFrame, k: int = 100) -> DataFrame:
    """Log likelihood with Dirichlet smoothing, mu = the mean document length.

    Every document has a score as soon as one term is in the index. A document
    without any query term scores by its length alone, and no better than a
    document of its length with one; so the k shortest documents, in order of
    (length, id), stand for all others: a query's best k are among those that
    match it and these. No query is crossed with all documents.
    """
    _, n_tokens, mu = collection_row(index)
    asked = hinted(queries.select("term").distinct())
    own = queries.join(hinted(index.terms.select("term", "cf").join(asked, "term", "left_semi")), "term")
    base = own.groupBy("query_id").agg(F.sum(F.log(mu * F.col("cf") / n_tokens)).alias("base"), F.count("*").alias("m"))
    gain = F.log(1 + F.col("tf") * n_tokens / (mu * F.col("cf")))
    hits = matched(index, queries).groupBy("query_id", "doc_id").agg(F.sum(gain).alias("gain"))
    short = index.lengths.orderBy("doc_len", "doc_id").limit(k)
    plain = base.select("query_id").crossJoin(F.broadcast(short.select("doc_id"))).withColumn("gain", F.lit(0.0))  # k rows a query
    both = hits.unionByName(plain).groupBy("query_id", "doc_id").agg(F.sum("gain").alias("gain"))
    rows = both.join(hinted(base), "query_id").join(index.lengths, "doc_id")
    return rows.select("query_id", "doc_id", (F.col("base") - F.col("m") * F.log(F.col("doc_len") + mu) + F.col("gain")).alias("score"))


MODELS = {"bm25": bm25, "cosine": cosine, "lm": likelihood}


def rank(index: Index, queries: DataFrame, model: str = "bm25", k: int = 100) -> DataFrame:
    """(query_id, doc_id, rank, score) by a model's name, in any case."""
    name = model.lower()
    if name not in MODELS:
        raise ValueError(f"unknown model {model!r}: one of {', '.join(MODELS)}")
    scores = likelihood(index, queries, k) if name == "lm" else MODELS[name](index, queries)
    return top(scores, k)


def bm25_scan(docs: DataFrame, queries: DataFrame, k: int = 100, stops=STOP_WORDS) -> DataFrame:
    """BM25 straight from texts, without an index: the same ranking in one scan.

    Only postings of query terms are shuffled, and for each document how many other
    tokens it has: the texts are split once, and the collection's figures are counted from what is left.
    """
    known = hinted(queries)
    asked = queries.select("term").distinct().withColumn("asked", F.col("term"))
    found = term_rows(docs, stops).join(hinted(asked), "term", "left").groupBy("doc_id", "asked").agg(F.count("*").alias("tf"))
    found = written(found.withColumn("doc_len", F.sum("tf").over(Window.partitionBy("doc_id"))), "found")
    size = collection_stats(found.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))).first()
    postings = found.filter("asked is not null").withColumnRenamed("asked", "term")
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    rows = postings.join(hinted(counts), "term").join(known, "term")
    weight = bm25_weight(F.lit(size["n_docs"]), F.col("df"), F.col("tf"), F.col("qtf"), F.col("doc_len"), F.lit(size["avg_len"]))
    return top(rows.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score")), k)
