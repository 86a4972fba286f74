"""Inverted indexes as three long tables: postings, terms and document statistics.

``postings`` is (term, doc_id, tf) or (term, doc_id, tf, positions), ``terms`` is
(term, df, cf, idf), ``doc_stats`` is (doc_id, doc_len, doc_norm2). Nested posting
lists appear only in sinks, so no plan holds a frequent term's list in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiquarry.functions import special, text
from lexiquarry.functions.stops import STOP_WORDS
from lexiquarry.operators.counting import per_document, phrases

KINDS = ("single", "stem", "positional", "phrase", "plain")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame

    @property
    def lengths(self) -> DataFrame:
        """(doc_id, doc_len): what takes no weights."""
        return document_lengths(self.postings)

    def collection(self) -> DataFrame:
        """One row: n_docs, n_tokens, avg_len."""
        return collection_stats(self.lengths)


def collection_stats(doc_stats: DataFrame) -> DataFrame:
    stats = doc_stats.agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens"))
    return stats.withColumn("avg_len", F.col("n_tokens") / F.col("n_docs"))


def term_rows(docs: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """(doc_id, term) of each base token that isn't a stop word.

    By explode_outer: before explode, Spark filters by the array's size, and so makes each array more than once.
    """
    every = docs.select("doc_id", F.explode_outer(text.tokens(F.col("text"))).alias("term"))
    return every.filter(F.col("term").isNotNull() & ~text.is_stop(F.col("term"), stops))


def plain_postings(docs: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """Base tokens of whole texts without stop words."""
    return per_document(docs.select("doc_id", text.tokens(F.col("text")).alias("t")), stops)


def stem_postings(docs: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """Stems of the base tokens that aren't stop words."""
    return per_document(docs.select("doc_id", text.tokens(F.col("text")).alias("t")), stops, stems=True)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the non-empty lines, numbered from 0."""
    return docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


def single_postings(docs: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """Special tokens of each line, then the base tokens of the rest without stop words."""
    lines = docs.select("doc_id", F.transform(text.lines(F.col("text")), text.decode_escapes).alias("lines"))
    marked = special.in_lines(lines)
    rest = text.terms(F.array_join(F.transform("marked", lambda x: x["rest"]), "\n"), stops)
    found = F.array_remove(F.concat(F.flatten(F.transform("marked", lambda x: x["special"])), rest), "")
    return per_document(marked.select("doc_id", found.alias("t")))


def positional_postings(docs: DataFrame) -> DataFrame:
    """Positions from 1 over all tokens of the document, stop words kept."""
    return per_document(docs.select("doc_id", text.tokens(F.col("text")).alias("t")), positions=True)


def placed_postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The positional postings of the terms in ``wanted`` (term) alone; no others are shuffled."""
    placed = docs.select("doc_id", F.posexplode_outer(text.tokens(F.col("text"))).alias("at", "term")).filter("term is not null")
    return placed.join(wanted, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))


def line_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, t): the phrase tokens of each line that has any."""
    found = F.transform(text.lines(F.col("text")), lambda x: text.phrase_tokens(text.decode_escapes(x)))
    return docs.select("doc_id", F.filter(found, lambda t: F.size(t) > 0).alias("t"))


def phrase_rows(docs: DataFrame, stops=STOP_WORDS) -> DataFrame:
    """(doc_id, line_no, phrase, crossing): phrases inside lines and over line ends."""
    found = line_rows(docs).select("doc_id", "line_no", text.phrase_tokens(text.decode_escapes(F.col("line"))).alias("t")).filter(F.size("t") > 0)
    flagged = found.withColumn("ok", text.phrase_flags(F.col("t"), stops))
    inside = flagged.select("doc_id", "line_no", F.explode(text.phrases(F.col("t"), F.col("ok"), 3)).alias("phrase")).withColumn("crossing", F.lit(False))
    return inside.unionByName(crossing_phrases(flagged))


def crossing_phrases(flagged: DataFrame) -> DataFrame:
    """Phrases that join the last words of a line to the first of the next."""
    last, before = F.element_at("t", -1), F.try_element_at("t", F.lit(-2))
    carried = F.when(F.try_element_at("ok", F.lit(-2)) & F.element_at("ok", -1), F.array(before, last)).when(F.element_at("ok", -1), F.array(last)).otherwise(F.array().cast("array<string>"))
    after = Window.partitionBy("doc_id").orderBy("line_no")
    edge = flagged.select("doc_id", "line_no", F.get("t", F.lit(0)).alias("t0"), F.get("t", F.lit(1)).alias("t1"), F.get("ok", F.lit(0)).alias("ok0"), F.coalesce(F.get("ok", F.lit(1)), F.lit(False)).alias("ok1"), F.lag(carried).over(after).alias("c"))
    whole = F.when(F.col("ok0") & (F.size("c") > 0), F.concat_ws(" ", F.array_join("c", " "), "t0"))
    pair = F.when(F.col("ok0") & F.col("ok1") & (F.size("c") > 0), F.concat_ws(" ", F.element_at("c", -1), "t0", "t1"))
    listed = F.filter(F.array(whole, pair), lambda p: p.isNotNull())
    return edge.filter("c is not null and size(c) > 0").select("doc_id", "line_no", F.explode(listed).alias("phrase"), F.lit(True).alias("crossing"))


def phrase_postings(docs: DataFrame, stops=STOP_WORDS, least_df: int = 1) -> DataFrame:
    """(term, doc_id, tf) of phrases in at least ``least_df`` documents."""
    found = phrases(line_tokens(docs), (*stops, *text.PHRASE_SIGNS))
    if least_df <= 1:
        return found
    common = found.withColumn("df", F.count("*").over(Window.partitionBy("term")))  # one exchange for the counts and for what they choose
    return common.filter(F.col("df") >= least_df).drop("df")


def term_stats(postings: DataFrame, n: DataFrame, base: float = 10.0) -> DataFrame:
    """(term, df, cf, idf) with idf = log_base(N / df); ``n`` is one row with N."""
    grouped = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return grouped.crossJoin(F.broadcast(n)).withColumn("idf", F.log10(F.col("n") / F.col("df")) / F.log10(F.lit(base))).drop("n")


def build_index(docs: DataFrame, kind: str = "single", stops=STOP_WORDS, base: float = 10.0) -> Index:
    """An index over (doc_id, text). Nothing but whether ids repeat is computed until its tables are used."""
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind!r}: one of {', '.join(KINDS)}")
    if kind == "positional":
        postings = positional_postings(docs)
    elif kind == "phrase":
        postings = phrase_postings(docs, stops, 2)
    elif kind == "single":
        postings = single_postings(docs, stops)
    else:
        postings = stem_postings(docs, stops) if kind == "stem" else plain_postings(docs, stops)
    return from_postings(postings, base)


def document_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def from_postings(postings: DataFrame, base: float = 10.0) -> Index:
    n = document_lengths(postings).agg(F.count("*").alias("n"))  # one row
    terms = term_stats(postings, n, base)
    return Index(postings, terms, doc_stats(postings, terms))


def doc_stats(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, doc_len, doc_norm2)."""
    weights = postings.join(terms.select("term", "idf"), "term")
    return weights.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("doc_norm2"))


def lexicon(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct().orderBy("term")


def nested(postings: DataFrame) -> DataFrame:
    """(term, df, postings): the sink form, lists sorted by document."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def lexicon_stats(terms: DataFrame) -> DataFrame:
    """One row: size, extreme df with their first terms, mean, mode and median df."""
    histogram = df_histogram(terms)
    mode = histogram.agg(F.max_by("df", F.struct("n_terms", -F.col("df"))).alias("mode_df"))
    main = terms.agg(
        F.count("*").alias("n_terms"),
        F.max("df").alias("max_df"),
        F.min_by("term", F.struct(-F.col("df"), "term")).alias("max_term"),
        F.min("df").alias("min_df"),
        F.min_by("term", F.struct("df", "term")).alias("min_term"),
        F.avg("df").alias("mean_df"),
        F.percentile("df", 0.5).alias("median_df"),
    )
    return main.crossJoin(mode)  # one row each


def df_histogram(terms: DataFrame) -> DataFrame:
    return terms.groupBy("df").agg(F.count("*").alias("n_terms"))
