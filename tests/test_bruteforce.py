"""Queries that SQL can't express, against plain Python over the tables that SQL confirms; files written and read again."""

import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lexiquarry.functions import stemmer
from lexiquarry.operators import cluster, dynamic, evaluate, index, ranking
from lexiquarry.plans import catalog
from lexiquarry.plans import oracles as sql
from lexiquarry.sources import readers, sinks
from lexiquarry.streaming import postings as arriving


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return con


def bm25(post, asked):
    """Scores of {term: {doc: tf}} for {term: qtf}; every document of the postings counts."""
    lengths = Counter()
    for docs in post.values():
        lengths.update(docs)
    n, mean = len(lengths), sum(lengths.values()) / len(lengths)
    scores = defaultdict(float)
    for term, qtf in asked.items():
        docs = post.get(term, {})
        rarity = math.log((n - len(docs) + 0.5) / (len(docs) + 0.5))
        for doc, tf in docs.items():
            scores[doc] += rarity * 2.2 * tf / (1.2 * (0.25 + 0.75 * lengths[doc] / mean) + tf) * 701 * qtf / (700 + qtf)
    return scores


def best(scores, k=100):
    return sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


def same_run(frame, want):
    got = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got[r["query_id"]])
        got[r["query_id"]].append(r["score"])
    assert set(got) == {q for q, rows in want.items() if rows}
    for q, scores in got.items():
        assert scores == pytest.approx([s for s, _ in want[q]], abs=2e-6)


def tree(con, query):
    post = defaultdict(dict)
    for term, doc, tf in con.execute(query).fetchall():
        post[term][doc] = tf
    return post


def topics_of(con, query):
    found = defaultdict(dict)
    for q, term, n in con.execute(query).fetchall():
        found[q][term] = n
    return found


def passes(lists, window=15):
    """The scan by positions instead of pointers: each list in turn drops what lies below the bound."""
    rest = [list(p) for p in lists]
    while all(rest):
        bound = max(p[0] for p in rest)
        rest = [[x for x in p if x >= bound - window] for p in rest]
        if all(p and p[0] < bound + window for p in rest):
            return True
    return False


def positional(con):
    return {(t, d): list(p) for t, d, p in con.execute(f"WITH {sql.POSITIONS} SELECT term, doc_id, positions FROM pos").fetchall()}


def test_proximity_scan(spark, sf_dir, con):
    lists = con.execute(f"WITH {sql.LISTS} SELECT key, doc_id, lists FROM lists").fetchall()
    want = sorted((k, d) for k, d, p in lists if passes(p))
    assert 0 < len(want) < len(lists)
    assert sorted((r["key"], r["doc_id"]) for r in catalog.proximity_scan(spark, sf_dir).collect()) == want


def test_dynamic_retrieval(spark, sf_dir, con):
    orc = catalog.oracle_sql()
    phrases, single = tree(con, orc["phrase_filtered"]), tree(con, sql.single_index(sql.special_lines([])))
    asked = topics_of(con, orc["topic_terms_single"])
    places, holders = positional(con), defaultdict(dict)
    for (term, doc), p in places.items():
        holders[term][doc] = len(p)
    titles = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = dynamic.query_phrases(spark.createDataFrame(titles, "query_id long, title string")).orderBy("query_id", "ord").collect()
    by_topic = defaultdict(list)
    for r in rows:
        by_topic[r["query_id"]].append(r["phrase"])
    assert Counter((q, p) for q, ps in by_topic.items() for p in ps) == Counter({(q, p): n for q, p, n in con.execute("SELECT query_id, phrase, n FROM (" + orc["query_phrases"] + ")").fetchall()})
    cache, want, routes = {}, {}, Counter()

    def hits(phrase):
        if phrase not in cache:
            terms = phrase.split(" ")
            docs = set.intersection(*(set(holders.get(t, {})) for t in terms))
            cache[phrase] = sum(passes([places[t, d] for t in terms]) for d in docs)
        return cache[phrase]

    for q, terms in asked.items():
        scores, close = {}, 0
        for phrase in by_topic[q]:
            if phrase in phrases:
                scores, last = bm25(phrases, {phrase: 1}), "phrase"
            elif all(t in holders for t in phrase.split(" ")):
                close += hits(phrase)
                if close:
                    scores, last = bm25(holders, dict.fromkeys(phrase.split(" "), 1)), "positional"
        routes[last if scores else "none"] += 1
        if len(scores) < 100 or not close:
            other = bm25(single, dict.fromkeys(terms, 1))
            scores = {d: (scores[d] + other[d]) / 2 if d in scores and d in other else scores.get(d, other.get(d)) for d in {*scores, *other}}
        want[q] = best(scores)
    assert len(routes) > 1
    same_run(catalog.dynamic_bm25(spark, sf_dir), want)


def test_hits_open_the_way_for_later_phrases(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue " + "x " * 40 + "whale"), (3, "green tree")], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "red fox the blue whale"), (2, "blue whale")], "query_id long, title string")
    phrase, places = index.build_index(docs, "phrase"), index.build_index(docs, "positional")
    routed, counts = dynamic.route(topics, phrase, places)
    assert sorted((r["query_id"], r["phrase"]) for r in routed.collect()) == [(1, "blue whale"), (1, "red fox")]
    assert [(r["query_id"], r["hits"]) for r in counts.collect()] == [(1, 1)]


def test_stemmed_index_and_ranking(spark, sf_dir, con):
    plain, post = tree(con, catalog.oracle_sql()["term_frequency"]), defaultdict(Counter)
    for term, docs in plain.items():
        post[stemmer.stem(term)].update(docs)
    got = {(r["term"], r["doc_id"]): r["tf"] for r in catalog.stem_index(spark, sf_dir).collect()}
    assert got == {(t, d): n for t, docs in post.items() for d, n in docs.items()}
    asked = defaultdict(Counter)
    for q, terms in topics_of(con, sql.PLAIN_ASKED).items():
        for term, n in terms.items():
            asked[q][stemmer.stem(term)] += n
    same_run(catalog.bm25_stem_topk(spark, sf_dir), {q: best(bm25(post, t)) for q, t in asked.items()})


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain_kmeans(vectors, k, rounds=cluster.MAX_ITER):
    centres, previous = vectors[:k].copy(), None
    for _ in range(rounds):
        near = np.argmax(np.round(unit(vectors) @ unit(centres).T, 12), axis=1)
        for c in set(near):
            centres[c] = vectors[near == c].mean(axis=0)
        total = sum(float(v @ unit(centres[c])) for v, c in zip(unit(vectors), near))
        if previous is not None and total - previous <= cluster.TOLERANCE * abs(previous):
            break
        previous = total
    sims = np.round(unit(vectors) @ unit(centres).T, 12)
    return np.argmax(sims, axis=1), sims, centres


def embedded(con):
    rows = sorted(con.execute("SELECT id, vec FROM (WITH " + sql.clusters(8) + " SELECT id, vec FROM vectors)").fetchall())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)


def test_kmeans_and_search_of_split_clusters(spark, sf_dir, con):
    ids, vectors = embedded(con)
    near, sims, centres = plain_kmeans(vectors, catalog.CLUSTERS)
    got = {r["id"]: (r["cluster"], r["sim"]) for r in catalog.kmeans_full(spark, sf_dir).collect()}
    assert {i: c for i, (c, _) in got.items()} == dict(zip(ids.tolist(), near.tolist()))
    assert [got[i][1] for i in ids] == pytest.approx(sims.max(axis=1), abs=2e-6)

    over = int(np.median(np.bincount(near, minlength=8)))  # so that some clusters are split and some aren't
    rows = catalog._vectors(spark, sf_dir)
    assigned, moved = cluster.kmeans(rows, catalog.CLUSTERS)
    found = cluster.search(catalog._query_vectors(spark, sf_dir), assigned, moved, least=20, k=10, split_over=over)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        pool, groups, middle = np.arange(len(ids)), near, centres
        first = int(np.argmax(np.round(unit(centres) @ unit(vectors[q]), 6)))
        if (near == first).sum() > over:
            pool = np.flatnonzero(near == first)
            groups, _, middle = plain_kmeans(vectors[pool], int(catalog.CLUSTERS * 0.75))
        order = sorted(range(len(middle)), key=lambda c: (-round(float(unit(middle[c]) @ unit(vectors[q])), 6), c))
        candidates = []
        for c in order:
            if len(candidates) >= 20:
                break
            candidates += pool[groups == c].tolist()
        want[int(ids[q])] = best({int(ids[m]): float(unit(vectors[m]) @ unit(vectors[q])) for m in candidates}, 10)
    same_run(found, want)


def test_judgements_by_rare_words_or_pieces(spark):
    texts = ["alpha beta gamma delta", "xalpha beta gammay", "beta", "a", "", None, "alpha  beta", "long" * 500 + " beta gamma " * 500]
    titles = ["alpha beta gamma", "beta gamma", "beta", "a", "lpha beta gam", "  ", "", "no such words here", "alpha  beta", "é", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    topics = spark.createDataFrame(list(enumerate(titles)), "query_id long, title string")
    want = sorted((q, d) for q, t in enumerate(titles) if t for d, x in enumerate(texts) if x and t in x)
    assert sorted((r["query_id"], r["doc_id"]) for r in evaluate.containing(docs, topics).collect()) == want
    assert evaluate.containing(docs.limit(0), topics).count() == 0 and evaluate.containing(docs, topics.limit(0)).count() == 0


def test_topics_are_parsed_by_index_type(spark):
    topics = spark.createDataFrame([(1, "The 50-mile running of Dec 31, 1993")], "query_id long, title string")
    terms = {k: {r["term"] for r in ranking.topic_terms(topics, kind=k).collect()} for k in ("plain", "single", "positional", "stem")}
    assert terms["single"] == {"12-31-1993", "50mile", "mile", "running"} and "12-31-1993" not in terms["plain"]
    assert "the" in terms["positional"] and "the" not in terms["plain"] and "run" in terms["stem"] and "running" in terms["plain"]
    with pytest.raises(ValueError):
        ranking.topic_terms(topics, kind="phrase")


# Files


def test_collection_topics_and_judgements_from_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one").write_text("<DOC>\n<DOCNO> D1 </DOCNO>\n<PARENT> P1 </PARENT>\n<TEXT>\n<!-- PJG -->\nred fox\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>D2</DOCNO><PARENT>P1</PARENT><TEXT></TEXT></DOC>")
    (tmp_path / "docs" / "two").write_text("<DOC><DOCNO> D3 </DOCNO><PARENT>P2</PARENT><TEXT>blue <i>whale</i></TEXT></DOC>")
    rows = {r["doc_id"]: (r["parent"], r["text"].strip()) for r in readers.read_collection(spark, str(tmp_path / "docs")).collect()}
    assert rows == {"D1": ("P1", "red fox"), "D2": ("P1", ""), "D3": ("P2", "blue whale")}
    (tmp_path / "topics").write_text("<top>\n<num> Number: 7\n<title> Topic: red fox\n\n<desc> Description:\nwhat\n<narr> Narrative:\nmore\n</top>\n")
    assert [tuple(r) for r in readers.read_topics(spark, str(tmp_path / "topics")).collect()] == [("7", "red fox", "what", "more")]
    (tmp_path / "qrels").write_text("7 0 D1 1\n7 0 D3 0\n")
    assert [(r["query_id"], r["doc_id"], r["rel"]) for r in readers.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [("7", "D1", 1), ("7", "D3", 0)]
    (tmp_path / "stops").write_text("the\n and \n\nthe\n")
    assert readers.read_stop_words(spark, str(tmp_path / "stops")) == ("and", "the")


def test_stored_lists_and_lengths_from_text(spark, tmp_path):
    (tmp_path / "index").write_text("fox\t2 0.5 3\t[['D1', '2'], ['D2', '1']]\nbroken line\n")
    assert sorted(tuple(r) for r in readers.read_weighted_index(spark, str(tmp_path / "index")).collect()) == [("fox", 2, 0.5, 3, "D1", 2), ("fox", 2, 0.5, 3, "D2", 1)]
    (tmp_path / "lengths").write_text("D1 12 3.25\n")
    assert [tuple(r) for r in readers.read_doc_lengths(spark, str(tmp_path / "lengths")).collect()] == [("D1", 12, 3.25)]


def content(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("kind", index.KINDS)
def test_an_index_is_read_as_written(spark, tmp_path, kind):
    docs = spark.createDataFrame([(1, "red fox jumps\nover it"), (2, "red fox jumps 50-mile"), (3, None), (4, "")], "doc_id long, text string")
    made = index.build_index(docs, kind)
    sinks.write_index(made, str(tmp_path), kind)
    read = sinks.load_index(spark, str(tmp_path), kind)
    for name in ("postings", "terms", "doc_stats"):
        assert content(getattr(read, name)) == content(getattr(made, name))
    sinks.write_lexicon(made.postings, str(tmp_path / "lexicon"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lexicon")).collect()) == sorted({r["term"] for r in made.postings.collect()})
    sinks.write_posting_text(made.postings, str(tmp_path / "lists"))
    assert "fox" in "".join(r[0] for r in spark.read.text(str(tmp_path / "lists")).collect())


def test_runs_are_appended_and_vectors_read_again(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 0, 2.5), (1, 4, 1, 1.25)], "query_id long, doc_id long, rank int, score double")
    for tag in ("BM25", "COSINE"):
        sinks.write_run(run, str(tmp_path / "run"), tag, mode="append")
    got = sorted((r["tag"], r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in readers.read_run(spark, str(tmp_path / "run")).collect())
    assert got == sorted((tag, "1", d, n, s) for tag in ("BM25", "COSINE") for d, n, s in (("5", 0, 2.5), ("4", 1, 1.25)))
    vectors = spark.createDataFrame([(1, [0.5, 0.0]), (2, [])], "id long, vec array<double>")
    sinks.write_vectors(vectors, str(tmp_path / "vectors"))
    assert content(spark.read.parquet(str(tmp_path / "vectors"))) == content(vectors)


def test_arriving_files_extend_the_index(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    texts = [(1, "red fox"), (2, "red tree"), (3, "blue fox fox")]
    for part in (texts[:2], texts[2:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        arriving.append_postings(spark, source, sink, state).awaitTermination(120)
    whole = index.build_index(spark.createDataFrame(texts, "doc_id long, text string"), "plain")
    now = arriving.current_index(spark, sink)
    assert content(now.postings) == content(whole.postings) and content(now.terms) == content(whole.terms)
