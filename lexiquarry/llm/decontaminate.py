"""Benchmark decontamination by a positional inverted index.

The index holds, for each document, the positions of the terms that the
benchmark needs most: the two rarest of every window, by their counts in the
whole corpus. It is partitioned by document, like the shards of a search
cluster, so the lists of one document are intersected where they lie. A window
is looked up from its rarest term: each posting, less the term's offset, is a
possible start; starts that the second list doesn't confirm are dropped; the
documents that are left are read again and compared word by word.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: null or wordless texts have no words and no hits; an item of
fewer than ``width`` words is one window of its own length; a wordless item has
none; repeated rows of documents each get their result; equal items each count;
columns other than the ids and texts are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import NON_WORD, ascii_lower, pieces, small, staged, two_hashes

#: Bytes up to which benchmark-derived tables are broadcast, after they are measured.
BROADCAST_BYTES = 32 << 20
#: Marks the end of a document in the exploded words; no word is empty.
END = ""


def word_array(text: Column) -> Column:
    return pieces(ascii_lower(text), NON_WORD)


def _documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return raw.select("doc_id", "text", *(h.alias(k) for k, h in zip(("k1", "k2"), two_hashes(F.col("doc_id"), F.col("text")))))


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(win, words, size, items): the distinct windows, with the items that hold them."""
    words = items.select(F.col(item_id).cast("string").alias("item"), word_array(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))).alias("at"))
    cut = starts.select("item", F.slice("w", F.col("at"), F.lit(width)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.array_join("words", " ")).alias("win"), "words", F.size("words").alias("size"), "items")


def _anchors(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, size, rare, rare_at, second, second_at): each window's two rarest terms by corpus count."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    listed, _ = small(terms, BROADCAST_BYTES)
    stream = docs.select(F.explode(word_array(F.col("text"))).alias("term"))
    counts = terms.join(stream.join(listed, "term").groupBy("term").count(), "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))
    placed = windows.select("win", "size", F.posexplode("words").alias("at", "term")).join(counts, "term")
    ranked = placed.groupBy("win", "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("order"))
    first, second = F.col("order")[0], F.try_element_at("order", F.lit(2))
    return ranked.select("win", "size", first["term"].alias("rare"), first["at"].alias("rare_at"), second["term"].alias("second"), second["at"].alias("second_at"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n_words, copies, postings): one row per distinct document.

    ``terms`` is (term, term_id). A posting is term_id * 2^32 + position, so a
    document's sorted array is its part of the inverted index.
    """
    listed, _ = small(terms.unionByName(terms.sparkSession.createDataFrame([(END, -1)], "term string, term_id long")), BROADCAST_BYTES)
    stream = docs.select("k1", "k2", "doc_id", F.posexplode(F.array_append(word_array(F.col("text")), END)).alias("at", "term"))
    found = stream.join(listed, "term")
    ended = F.col("term_id") == -1
    return found.groupBy("k1", "k2").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(ended, F.col("at").cast("long"))).alias("n_words"),
        F.count(F.when(ended, 1)).alias("copies"),
        F.collect_set(F.when(~ended, packed(F.col("term_id"), F.col("at")))).alias("postings"),
    )


def packed(term_id: Column, at: Column) -> Column:
    return F.shiftleft(term_id, 32) + at.cast("long")


def _matches(index: DataFrame, anchors: DataFrame, ids: DataFrame) -> DataFrame:
    """(k1, k2, win, size, at): starts, from 0, that the two rarest lists agree on."""
    rare = ids.select(F.col("term").alias("rare"), F.col("term_id").alias("rare_id"))
    second = ids.select(F.col("term").alias("second"), F.col("term_id").alias("second_id"))
    looked = anchors.join(rare, "rare").join(second, "second", "left").select("win", "size", "rare_id", "rare_at", "second_id", "second_at")
    looked, _ = small(looked, BROADCAST_BYTES)
    lists = index.filter(F.size("postings") > 0).select("k1", "k2", "n_words", "postings", F.explode("postings").alias("posting"))
    lists = lists.withColumn("rare_id", F.shiftright("posting", 32))
    start = F.col("posting").bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("rare_at")
    confirmed = F.col("second_id").isNull() | F.array_contains("postings", packed(F.col("second_id"), F.col("at") + F.col("second_at")))
    return lists.join(looked, "rare_id").withColumn("at", start).filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n_words")) & confirmed).select("k1", "k2", "win", "size", "at")


def occurrences(documents: DataFrame, items: DataFrame, width: int = 8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index, and every exact phrase occurrence (k1, k2, at, size, items)."""
    docs = _documents(documents, doc_id, text)
    windows = staged(item_windows(items, item_id, item_text, width), "windows")
    anchors = staged(_anchors(docs, windows), "anchors")
    terms = anchors.select(F.explode(F.array("rare", "second")).alias("term")).filter("term is not null").distinct()
    ids = staged(terms.select("term", F.abs(F.xxhash64("term") % (1 << 30)).alias("term_id")), "terms")
    index = staged(build_index(docs, ids), "postings")
    survivors = _matches(index, anchors, ids)
    listed, _ = small(windows, BROADCAST_BYTES)
    wanted = survivors.groupBy("k1", "k2").agg(F.collect_list(F.struct("win", F.col("at").cast("int").alias("at"))).alias("starts"))
    read = docs.join(wanted, ["k1", "k2"]).select("k1", "k2", word_array(F.col("text")).alias("w"), "starts")
    each = read.select("k1", "k2", "w", F.explode("starts").alias("s")).select("k1", "k2", "w", "s.win", "s.at")
    exact = each.join(listed, "win").filter(F.slice("w", F.col("at") + 1, F.col("size")) == F.col("words"))
    return index, exact.select("k1", "k2", "at", "size", "items")


def proximity(documents: DataFrame, items: DataFrame, span: int, width: int = 8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item, at): windows whose two rarest terms lie within ``span`` words, in either order.

    ``at`` is the place of the rarest term. A window of one term matches where it occurs.
    """
    docs = _documents(documents, doc_id, text)
    windows = staged(item_windows(items, item_id, item_text, width), "windows")
    anchors = staged(_anchors(docs, windows), "anchors")
    terms = anchors.select(F.explode(F.array("rare", "second")).alias("term")).filter("term is not null").distinct()
    ids = staged(terms.select("term", F.abs(F.xxhash64("term") % (1 << 30)).alias("term_id")), "terms")
    index = build_index(docs, ids)
    rare = ids.select(F.col("term").alias("rare"), F.col("term_id").alias("rare_id"))
    second = ids.select(F.col("term").alias("second"), F.col("term_id").alias("second_id"))
    looked, _ = small(anchors.join(rare, "rare").join(second, "second", "left").select("win", "rare_id", "second_id"), BROADCAST_BYTES)
    lists = index.filter(F.size("postings") > 0).select("doc_id", "postings", F.explode("postings").alias("posting")).withColumn("rare_id", F.shiftright("posting", 32))
    low = F.col("posting").bitwiseAND(F.lit(0xFFFFFFFF))
    near = F.exists("postings", lambda p: (F.shiftright(p, 32) == F.col("second_id")) & (p != F.col("posting")) & (F.abs(p.bitwiseAND(F.lit(0xFFFFFFFF)) - low) <= span))
    hit = lists.join(looked, "rare_id").filter(F.col("second_id").isNull() | near)
    return hit.select("doc_id", "win", low.alias("at")).join(windows.select("win", F.explode("items").alias("item")), "win").select("doc_id", "item", "at").distinct()


def keep(documents: DataFrame, items: DataFrame, width: int = 8, min_items: int = 1, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold windows of fewer than ``min_items`` items, columns as they are."""
    _, exact = occurrences(documents, items, width, doc_id, text, item_id, item_text)
    found = exact.groupBy("k1", "k2").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n"))
    bad, _ = small(staged(found.filter(F.col("n") >= min_items).select("k1", "k2"), "leaks"))
    keys = two_hashes(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns))).alias("row"), *(h.alias(k) for h, k in zip(keys, ("k1", "k2"))))
    return rows.join(bad, ["k1", "k2"], "left_anti").select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns)))


def contamination(documents: DataFrame, items: DataFrame, width: int = 8, min_items: int = 2, **names: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    index, exact = occurrences(documents, items, width, **names)
    covered = exact.select("k1", "k2", "items", F.sequence(F.col("at"), F.col("at") + F.col("size") - 1).alias("span"))
    found = covered.groupBy("k1", "k2").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("span")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    whole = index.select("k1", "k2", "doc_id", "n_words", "copies").join(found, ["k1", "k2"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    result = whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.size(listed) >= min_items).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return result.drop("copy")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 7) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS win, least(len(w), 8) AS size
  FROM item_words WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM words, sizes WHERE len(w) >= size
), hits AS (
  SELECT r.doc_id, r.pos, r.size, x.item_id
  FROM (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM runs) r JOIN windows x USING (win, size)
), marked AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
