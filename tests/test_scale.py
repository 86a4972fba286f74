"""What keeps the engine's queries in proportion to their input."""

import random

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import special, text
from lexiquarry.functions.stemmer import stemmed
from lexiquarry.functions.stops import STOP_WORDS
from lexiquarry.operators import cluster, counting, dynamic, index, ranking
from lexiquarry.operators.staging import written
from lexiquarry.plans import catalog


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_texts_cut_as_a_whole_give_the_tokens_that_pieces_give(spark):
    rng = random.Random(4)
    signs = list(text.PUNCTUATION + " \t\n\x0b ○•aZ") + ["É", "Σ", "ß", "İ", "K", "ΑΣ", "σ", "中", "a,b", "...", "--", " - "]
    odd = ["", " ", ".", "a", "ΑΣ:Α Α:Σ", "ΟΔΟΣ, ΟΔΟΣ.", "(U.S.A.)", "'tis -- 'twas'", "a.-b c", "a.- b", "\"x\"", None]
    rows = [(i, t) for i, t in enumerate(odd + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)])]
    pieces = F.filter(F.transform(F.split("text", text.SEPARATORS), text.normalize), lambda t: t != "")
    got = spark.createDataFrame(rows, "i int, text string").select("text", pieces.alias("a"), text.tokens(F.col("text")).alias("b")).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.a != r.b] == []


def test_the_scan_splits_texts_once(spark):
    """Before, they were split for the postings, for their counts and for the lengths, and each time once more to see whether there is a token."""
    docs = spark.createDataFrame([(1, "red fox"), (2, "the"), (3, "fox fox hen"), (4, None), (5, "owl hen")], "doc_id long, text string")
    asked = ranking.topic_terms(spark.createDataFrame([(1, "fox hen"), (2, "none")], "query_id long, title string"))
    run = ranking.bm25_scan(docs, asked)
    assert "trim(text" not in plan(run)
    assert plan(index.term_rows(docs)).count("split(lower") == 1
    held = ranking.rank(index.build_index(docs, "plain"), asked)
    assert sorted(run.collect()) == sorted(held.collect()) and run.count() == 3


def odd_lines(n: int = 400) -> list[str]:
    rng = random.Random(8)
    words = "Fox the red. U.S. AT j.doe@mail.example.org 10.20.30.40 1/2/2012 Jan 5, 94, $12.50 §§3.5 co-operate 50-mile x-1-2 http://www.a.org/b report.PDF a&hyph;b 2&times;3 owl's , - ' of 中文 ΟΔΟΣ:Α".split(" ")
    return ["", "red", "the", "red fox", "a b c d"] + [rng.choice(["", " ", "\n"]).join(rng.choices(words, k=1)) + " ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(n)]


def documents(spark, repeated: bool):
    rng, lines = random.Random(9), odd_lines()
    rows = [(i // 2 if repeated else i, rng.choice(["\n", "\r\n", "\n\n"]).join(rng.choices(lines, k=rng.randrange(6)))) for i in range(300)]
    return spark.createDataFrame(rows + [(1000, None)], "doc_id long, text string")


def rows_of(frame) -> list:
    return sorted(tuple(r) for r in frame.collect())


def counted(rows):
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


@pytest.mark.parametrize("repeated", [False, True])
def test_postings_are_counted_within_documents(spark, repeated, monkeypatch):
    """Before, each posting was shuffled. Documents that share an id are still one."""
    monkeypatch.setattr(counting, "SLICE", 50)
    docs = documents(spark, repeated)
    pieces = docs.select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("at", "term"))
    placed = pieces.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))
    plain = counted(pieces.filter(~text.is_stop(F.col("term"))).select("doc_id", "term"))
    marked = special.with_special(index.line_rows(docs).select("doc_id", text.decode_escapes(F.col("line")).alias("line")))
    single = counted(marked.select("doc_id", F.explode(F.concat("special", text.terms(F.col("rest")))).alias("term")).filter("term <> ''"))
    phrase = counted(index.phrase_rows(docs).select("doc_id", F.col("phrase").alias("term")))
    inside = counted(index.phrase_rows(docs).filter("not crossing").select("doc_id", F.col("phrase").alias("term")))
    common = phrase.join(phrase.groupBy("term").count().filter("count > 1"), "term", "left_semi")
    for made, expected in (
        (index.positional_postings(docs), placed),
        (index.plain_postings(docs), plain),
        (index.stem_postings(docs), stemmed(plain)),
        (index.single_postings(docs), single),
        # Lines of texts that share an id have no order among each other, so that phrases over line ends are those of each text.
        *([] if repeated else [(index.phrase_postings(docs), phrase), (index.phrase_postings(docs, least_df=2), common)]),
        (counting.phrases(index.line_tokens(docs), (*STOP_WORDS, *text.PHRASE_SIGNS), crossing=False), inside),
    ):
        got = rows_of(made)
        assert len(got) > 100 and got == rows_of(expected)
    assert repeated or "Exchange" not in index.plain_postings(docs)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_marked_as_before(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(odd_lines(2000))], "i int, line string")
    found = special.in_lines(lines.select("i", F.array("line").alias("lines"))).select("i", "marked.special", "marked.rest")
    assert rows_of(found.select("i", F.col("special")[0], F.col("rest")[0])) == rows_of(special.with_special(lines).select("i", "special", "rest"))


def test_a_held_index_makes_only_what_is_read(spark, sf_dir, monkeypatch):
    """Before, weights of all documents were made for queries that read postings or terms alone."""
    made = []
    monkeypatch.setattr(catalog, "written", lambda frame, label: (made.append(label), written(frame, label))[1])
    monkeypatch.setattr(catalog, "_held", {})
    catalog.positional_index(spark, sf_dir)
    assert made == ["positional-postings"]
    catalog.doc_term_matrix(spark, sf_dir)
    assert "plain-terms" in made and "plain-docs" not in made


@pytest.mark.parametrize("repeated", [False, True])
def test_lists_are_met_within_documents(spark, repeated, monkeypatch):
    """Before, all positions were written, and those of frequent terms met each phrase they are in."""
    monkeypatch.setattr(counting, "SLICE", 50)
    docs = documents(spark, repeated)
    keys = ["red fox", "fox red fox", "the red", "red red", "red nowhere", "nowhere", "fox u.s at", "of 中文", "a b c", "co-operate red"]
    wanted = dynamic.phrase_terms(spark.createDataFrame([(k,) for k in keys], "phrase string"))
    places = {}
    for r in index.positional_postings(docs).collect():
        places[r.term, r.doc_id] = r.positions
    ids = {d for _, d in places}
    expected = sorted((k, d, [places[t, d] for t in k.split(" ")]) for k in keys for d in ids if all((t, d) in places for t in k.split(" ")))
    made = dynamic.lists_in(docs, wanted)
    assert len(expected) > 100 and rows_of(made) == expected
    assert rows_of(dynamic.intersection(index.positional_postings(docs), wanted)) == expected
    assert repeated or "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    none = dynamic.phrase_terms(spark.createDataFrame([], "phrase string"))
    assert dynamic.lists_in(docs, none).count() == 0


def test_cells_give_what_all_pairs_give(spark, monkeypatch):
    """Before, all pairs of a cluster were made in one task, by a join on the cluster alone. Equal vectors tie, and go by their ids."""
    for name, value in (("MEMBERS", 20), ("ASKING", 7), ("AT_ONCE", 3)):
        monkeypatch.setattr(cluster, name, value)
    rng = random.Random(6)
    same = [rng.random() for _ in range(5)]
    vectors = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(5)], i % 2) for i in range(180)]
    members = spark.createDataFrame(vectors, "id long, vec array<double>, cluster int")
    asking = members.filter("id % 5 < 2").select(F.col("id").alias("query_id"), (F.col("id") % 2).cast("int").alias("cluster"), F.col("vec").alias("q"))
    every = asking.join(members, "cluster").select("query_id", "id", F.round(cluster.cosine(F.col("q"), F.col("vec")), 6).alias("score")).collect()
    expected = {}
    for r in sorted(every, key=lambda r: (r.query_id, -r.score, r.id)):
        expected.setdefault(r.query_id, []).append((r.score, r.id))
    made = cluster._scored(asking, members, 10)
    got = {}
    for r in sorted(made.select("query_id", "id", F.round("score", 6).alias("score")).collect(), key=lambda r: (r.query_id, -r.score, r.id)):
        got.setdefault(r.query_id, []).append((r.score, r.id))
    assert {q: x[:10] for q, x in got.items()} == {q: x[:10] for q, x in expected.items()}
    assert made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(cluster") == 2
    uneven = members.unionByName(spark.createDataFrame([(500, [1.0], 0)], members.schema))
    assert cluster._scored(asking, uneven, 10).count() == len(every) + asking.filter("cluster = 0").count()


def test_large_clusters_are_clustered_again_in_the_same_rounds(spark, monkeypatch):
    """Before, each had its own rounds, one after the other. Each gets the parts that it gets alone."""
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(150)], "id long, vec array<double>, parent int")
    moves, move = [], cluster._move
    monkeypatch.setattr(cluster, "_move", lambda *a: (moves.append(1), move(*a))[1])
    first = {p: {i: list(r.vec) for i, r in enumerate(rows.filter(F.col("parent") == p).orderBy("id").limit(4).collect())} for p in range(3)}
    _, together = cluster._rounds(rows, first)
    joint, alone = len(moves), []
    for p in range(3):
        moves.clear()
        centres = {r.cluster: r.centroid for r in cluster.kmeans(rows.filter(F.col("parent") == p).select("id", "vec"), 4)[1].collect()}
        alone.append(len(moves))
        assert {c: pytest.approx(v, abs=1e-9) for c, v in together[p].items()} == centres
    assert joint == max(alone)
