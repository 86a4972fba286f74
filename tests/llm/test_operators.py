"""The corpus operators: brute force, held-out accuracy, and empty, null and repeated rows."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiquarry.llm import ann, decontaminate, extract, linededup, mixing, pii, quality, queries, simhash, substring, toxicity
from lexiquarry.llm.common import sieve, staged

SCHEMA = "doc_id long, text string, source string"
ODD = [(1, None, None), (2, "", "a"), (3, "one two three four five six", "a"), (4, "one two three four five six", "a"), (5, "x" * 5000 + " tail", None)]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_simhash_components_by_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf_dir).collect()}
    prints = {d: int(f, 16) for d, (f, _) in got.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: c for d, (_, c) in got.items()} == {d: find(d) for d in ids}


def test_line_dedup_keeps_the_first_of_a_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    docs = spark.createDataFrame([(1, f"alone here\n{base}"), (2, f"  {base.upper()}\nsecond"), (3, near), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.deduplicate(docs).collect()}
    assert got[1] == (f"alone here\n{base}", 0) and got[2] == ("second", 1)
    assert got[4] == (None, 0) and got[5] == ("", 0)


def test_line_dedup_finds_the_near_lines_of_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    lines = staged(linededup.distinct_lines(linededup.line_table(docs)), "lines")
    texts = linededup._split(docs).select(linededup.two_hashes(F.col("line"))[0].alias("id"), "line").distinct().withColumn("n", F.length("line"))
    texts = texts.filter(F.col("n") <= linededup.LONG_LINE).repartition(8)
    left, right = (texts.select(*(F.col(c).alias(c + s) for c in ("id", "line", "n"))) for s in "ab")
    pairs = left.join(F.broadcast(right), (F.col("na") >= F.col("nb")) & (F.col("nb") >= 0.8 * F.col("na") - 1) & (F.col("ida") != F.col("idb")))
    pairs = [(r.ida, r.idb) for r in pairs.filter("levenshtein(linea, lineb, cast(floor(na * 0.200000001D) as int)) >= 0").select("ida", "idb").collect()]
    root = {r.id: r.root for r in linededup.fuzzy_groups(docs, lines).collect()}
    together = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert len(pairs) >= 40 and together >= 0.98 * len(pairs)


@pytest.mark.parametrize("words, changed", [(6, 1), (20, 2), (60, 6)])
def test_line_dedup_finds_lines_with_changed_words(spark, words, changed):
    rng = np.random.default_rng(words + changed)
    rows = []
    for i in range(100):
        line = [f"{x:08x}" for x in rng.integers(0, 1 << 32, words)]
        other = list(line)
        for at in rng.choice(words, changed, replace=False):
            other[at] = f"{rng.integers(0, 1 << 32):08x}"
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] for i in range(100)) == 0 and sum(got[2 * i + 1] for i in range(100)) >= 97


def test_line_dedup_deals_with_hot_pairs_of_words(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 32)
    rng = np.random.default_rng(7)
    common = "extraordinarily incomprehensibilities"
    lines = [common + " " + " ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, 20)) for _ in range(300)]
    near = [x.rsplit(" ", 1)[0] + " zz" for x in lines[:60]]
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(docs).collect()}
    assert sum(got[i] for i in range(300)) == 0 and sum(got[i] for i in range(300, 360)) >= 57


def test_line_dedup_leaves_no_pair_of_a_hot_bucket_out(spark, monkeypatch):
    """Near lines that lack the four rarest words after the hot pair share half of their kept words, but no other pair of the first four."""
    monkeypatch.setattr(linededup, "HOT", 32)
    rng = np.random.default_rng(11)
    common = "extraordinarily incomprehensibilities"
    lines = [common + " " + " ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, 22)) for _ in range(300)]
    ranked = spark.createDataFrame(list(enumerate(lines)), "i long, line string").selectExpr("i", "explode(split(line, ' ')) as w").selectExpr("i", "w", "shiftrightunsigned(xxhash64(w), length(w)) as h")
    order = {}
    for r in ranked.orderBy("i", "h").collect():
        order.setdefault(r.i, []).append(r.w)
    near = []
    for i in range(60):
        gone = dict(zip([w for w in order[i] if w not in common][:4], "qwzv"))
        near.append(" ".join(gone.get(w, w) for w in lines[i].split(" ")))
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(300)) == 0 and sum(got[i] for i in range(300, 360)) == 60


def test_line_dedup_reads_no_texts_of_lines_that_share_a_key_by_chance(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common = "extraordinarily incomprehensibilities"
    lines = [common + " " + " ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, 20)) for _ in range(200)]
    near = [x.rsplit(" ", 1)[0] + " zz" for x in lines[:20]]
    read, texts = [], linededup._texts
    monkeypatch.setattr(linededup, "_texts", lambda documents, table, ids: (read.append(ids.count()), texts(documents, table, ids))[1])
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(200)) == 0 and sum(got[i] for i in range(200, 220)) >= 19
    assert sum(read) <= 60


def test_line_dedup_compares_over_all_partitions_and_in_characters_last(spark, monkeypatch):
    """Few bytes can take long to compare; and of the lines that share a rare pair, those that words have linked already aren't compared in characters."""
    rng = np.random.default_rng(5)
    common = "extraordinarily incomprehensibilities"
    lines = [common + " " + " ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, 12)) for _ in range(60)]
    words = [x.rsplit(" ", 1)[0] + " zz" for x in lines[:20]]
    # Four of 14 words by one letter each: too far in words, near in characters.
    letters = [" ".join(w[:-1] + "z" if i in (2, 3, 4, 5) else w for i, w in enumerate(x.split(" "))) for x in lines[20:40]]
    seen, paired = [], linededup._paired
    monkeypatch.setattr(linededup, "_paired", lambda *a, **k: (seen.append((a[0], paired(*a, **k))), seen[-1][1])[1])
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(spark.createDataFrame(list(enumerate(lines + words + letters)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(60)) == 0 and sum(got[i] for i in range(60, 80)) >= 19 and sum(got[i] for i in range(80, 100)) >= 19
    assert len(seen) == 2 and all("REPARTITION_BY_NUM" in p._jdf.queryExecution().executedPlan().toString() for _, p in seen)


def test_line_dedup_compares_a_hot_bucket_in_cells_that_leave_no_pair_out(spark):
    """No task compares more than a cell of two buckets' worth of pairs, and each line outside meets each of its bucket once."""
    rows = [(k, i, i % 3 > 0, n) for k, n in ((1, 20), (2, 400), (3, 1500)) for i in range(n)]
    left, right = linededup._cells(spark.createDataFrame(rows, "key long, id long, outside boolean, n long"), [])
    pairs = left.join(right, ["key", "block", "cell"]).groupBy("key", "block", "cell").agg(F.count("*").alias("p"), F.count_distinct("a", "b").alias("d"))
    got = {r.key: r for r in pairs.groupBy("key").agg(F.max("p").alias("most"), F.sum("p").alias("p"), F.sum("d").alias("d")).collect()}
    for n, k in ((20, 1), (400, 2), (1500, 3)):
        outside = sum(i % 3 > 0 for i in range(n))
        assert got[k].p == got[k].d == outside * n and got[k].most <= max(32 * 32, 2 * n)


def test_line_dedup_splits_only_documents_that_hold_wanted_lines(spark):
    docs = spark.createDataFrame([(i, f"line number {i} here\nother {i}") for i in range(50)], "doc_id long, text string").withColumn("text_id", F.xxhash64("text"))
    lines = staged(linededup.distinct_lines(linededup.line_table(docs)), "lines")
    found = linededup._texts(docs, lines, lines.filter("doc_id = 7").select(F.col("k1").alias("id")))
    assert sorted(r.line for r in found.collect()) == ["line number 7 here", "other 7"]
    assert "bit_get" in found._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1]


def test_line_dedup_makes_no_table_twice_and_compares_no_line_in_vain(spark, monkeypatch):
    """Only staged tables are measured, as others would be made once more for that; short lines, compared in characters at first, aren't compared again later."""
    rng = np.random.default_rng(9)
    common = "extraordinarily incomprehensibilities"
    lines = [common + " " + " ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, n)) for n in [12] * 40 + [5] * 40]
    near = [x.rsplit(" ", 1)[0] + " zz" for x in lines]
    measured, compared, small, paired = [], [], linededup.small, linededup._paired
    monkeypatch.setattr(linededup, "small", lambda frame, *a, within=None, **k: (measured.append(within if within is not None else frame), small(frame, *a, within=within, **k))[1])
    monkeypatch.setattr(linededup, "_paired", lambda rows, *a, **k: (compared.append(rows), paired(rows, *a, **k))[1])
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicate(spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(80)) == 0 and sum(got[i] for i in range(80, 160)) >= 78
    plans = [m._jdf.queryExecution().optimizedPlan().toString() for m in measured]
    assert len(plans) >= 9 and not any(x in p for p in plans for x in ("Aggregate", "Generate"))
    assert len(compared) == 2 and "words#" in (late := compared[1]._jdf.queryExecution().optimizedPlan().toString()) and f"> {linededup.SHORT})" in late


def test_line_dedup_keeps_the_least_different_words(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [3, 1, 2]), (3, [5] * 40 + [4] * 3), (4, [*range(30, 0, -1)] * 3), (5, [1] * 9 + [*range(2, 9)])], "i long, f array<long>")
    got = {r.i: r.w for r in linededup._least(rows, F.col("f"), "w").collect()}
    assert got == {0: None, 1: [], 2: [1, 2, 3], 3: [4, 5], 4: [*range(1, 9)], 5: [*range(1, 9)]}


def test_line_dedup_deals_out_the_members_of_buckets_once(spark):
    rows = spark.createDataFrame([(i % 50, i, 20, 1) for i in range(500)], "key long, id long, chars int, copies long")
    found = linededup._buckets(rows, 0.8)
    assert found.count() == 500
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_sieve_keeps_all_it_holds_and_few_others(spark):
    held = spark.range(2000).select(F.xxhash64("id").alias("h"))
    got = spark.range(20_000).filter(sieve(held, F.xxhash64("id"))).selectExpr("count_if(id < 2000) as held", "count(*) as n").first()
    assert got.held == 2000 and got.n <= 2000 + 900
    assert spark.range(100).filter(sieve(held.limit(0), F.xxhash64("id"))).count() == 0


def test_decontamination_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op10_decontaminate"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op10_decontaminate(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].equals(want[sorted(got)].astype(got[sorted(got)].dtypes.to_dict()))


def test_mix_meets_targets(spark, sf_dir):
    got = mixing.taken(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.target) <= r.m
    assert got.filter("taken > 2 * size").count() == 0


def test_neighbours_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf_dir, "embeddings").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hit = total = 0
    found = {}
    for r in queries.op5_ann(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        best = [ids[j] for j in np.lexsort((ids, -score)) if j != i][:20]
        hit, total = hit + len(found[ids[i]] & set(best)), total + len(best)
    assert hit >= 0.9 * total


def test_neighbours_recall_over_many_partitions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(x))
    frame = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}))
    monkeypatch.setattr(ann, "SLICE_ROWS", 30, raising=False)
    found = {}
    for r in ann.search(frame, F.col("vec_id") % 400 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide, hit = x.astype(float), 0
    for i in ids[::400]:
        got = sorted(found[i])
        assert [r for r, _, _ in got] == list(range(1, 21))
        hit += len({v for _, v, _ in got} & {v for v, _ in ann.exact(wide, ids, wide[i], i, 20)})
    assert len(found) == 100 and hit >= 0.97 * 2000


@pytest.mark.parametrize("name, label, mod, held", [("op8_quality", "quality", 5, 0), ("op9_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, mod, held):
    sf_dir = os.environ.get("TEST_LABEL_DIR", "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in queries.queries()[name](spark, sf_dir).collect()}
    pairs = [(got[r.doc_id].predicted, r[label], got[r.doc_id].score) for r in read(spark, sf_dir, "labels").collect() if r.doc_id in got and got[r.doc_id].held_out and r[label] is not None]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % mod == held) for d, r in got.items())
    ones, zeros = [s for _, y, s in pairs if y], [s for _, y, s in pairs if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) >= 0.9  # AUC: a constant score has 0.5
    assert np.mean([p for p, y, _ in pairs if y]) + np.mean([1 - p for p, y, _ in pairs if not y]) >= 1.6  # balanced accuracy of 0.8


def test_substring_cuts_the_second_copy(spark):
    rng = np.random.default_rng(1)
    words = [f"{x:x}" for x in rng.integers(0, 1 << 30, 400)]
    passage = " ".join(words[:150])
    docs = [(1, " ".join(words[150:200]) + " " + passage), (2, passage + " " + " ".join(words[200:260])), (3, None)]
    got = {r.doc_id: r for r in substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].cut_bytes == 0 and got[3].text == ""
    assert got[2].cut_bytes >= 0.8 * len(passage)
    whole = docs[1][1].encode()
    gone = sorted((s.start, s.end) for s in got[2].spans)
    left = b"".join(whole[a:b] for a, b in zip([0] + [e for _, e in gone], [s for s, _ in gone] + [len(whole)]))
    assert left.decode() == got[2].text


def test_extract_keeps_the_article():
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>First  long\nparagraph with quite a few words in it.</p></article><footer>Imprint</footer></body></html>"
    assert extract.main_text(page) == "A & B\nFirst long paragraph with quite a few words in it."
    assert extract.main_text(None) == "" == extract.main_text("")


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head hidden><title>t</title><meta charset=utf-8><body><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><script>x</script><style>y</style><p>one</p>", ["one"]),
        ("<head><title>t</title><link href=x></head><body><p>one</p></body>", ["one"]),
        ('<p>one</p><p><svg width="1"/>two</p><p>three</p>', ["one", "two", "three"]),
        ("<p>one <math/>two</p><svg viewBox='0 0 1 1' /><p>three</p><svg><text>no</text></svg>", ["one two", "three"]),
        ("<p>one<svg href=a/>no</svg></p><p>two<svg><path d='m'/>no</svg></p>", ["one", "two"]),
        ("<p>one</p><div><video src=x></div><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>no <p>no</p>", ["one"]),
    ],
)
def test_extract_skips_no_more_than_html_does(page, want):
    assert [b[0] for b in extract.blocks(page)] == want


def test_personal_data_is_replaced_wherever_it_stands(spark):
    docs = spark.createDataFrame(
        [(1, "Mrs Anna Smith came. Smith's car, Smithson, then Anna left; call 555 123 4567."), (2, "Card 3782 822463 10005 of Mr Smith."), (3, "Smith alone stays"), (4, None)],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.text, r.n_mentions) for r in pii.replace(docs, "secret").collect()}
    text, n = got[1]
    given, surname = text.split()[1], text.split()[2]
    assert n == 4 and "555 123 4567" not in text and "Smith" not in (given, surname)
    assert text.startswith(f"Mrs {given} {surname} came. {surname}'s car, Smithson, then {given} left; call ")
    assert got[2][1] == 2 and "3782 822463 10005" not in got[2][0] and got[2][0].endswith(f" of Mr {surname}.")
    assert got[3] == ("Smith alone stays", 0) and got[4] == (None, 0)


def test_odd_and_empty_rows(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    groups = {r.doc_id: r.component_id for r in simhash.components(odd).collect()}
    assert groups[2] == 1 and groups[4] == 3
    assert sorted(r.size for r in mixing.taken(odd).collect()) == [0, 0, 2, 6, 6]
    assert simhash.components(none).count() == 0 == substring.deduplicate(none).count() == mixing.taken(none).count()


def test_fingerprints_by_brute_force(spark):
    from xxhash import xxh64_intdigest

    texts = ["A b  C d\tE", "one two", "Ä ß x y z x y z", "", None]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g, 42) for g in grams]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_substring_by_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  é") for _ in range(rng.randint(80, 600))) for _ in range(12)]
    rows = [(rng.randint(1, 40), "".join(rng.choice(passages) + "".join(rng.choice("abcdefghij") for _ in range(50)) for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    rows += rows[:5] + [(None, passages[0]), (3, None), (4, ""), (5, passages[1] * 300)]  # repeated rows and ids, no id, no text, a long text
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    version = {r.text: r.v for r in docs.select("text", F.hash("text").alias("v")).distinct().collect()}
    seen, spans = set(), {}
    for d, _, t in sorted({(d, version[t], t or "") for d, t in rows if d is not None}):
        at, again = 0, []
        for end in substring.cuts(t.encode()):
            piece = t.encode()[at:end]
            again += [at << 9 | (end - at)] if piece in seen else []
            seen.add(piece)
            at = end
        spans[d, t] = substring.spans(again)
    want = Counter()
    for d, t in rows:
        body, own = (t or "").encode(), spans.get((d, t or ""), [])
        want[d, b"".join(body[a:b] for a, b in zip([0] + [e for _, e in own], [s for s, _ in own] + [len(body)])).decode(), tuple(own)] += 1
    assert Counter((r.doc_id, r.text, tuple((s.start, s.end) for s in r.spans)) for r in substring.deduplicate(docs).collect()) == want
    assert sum(map(len, spans.values())) > 50


@pytest.mark.parametrize(
    "text, gone, n",
    [
        ("John Smith met DR MÜLLER and Dr Müller", ["John", "Smith", "MÜLLER", "Müller"], 3),
        ("SSN 123-45-6789, IBAN DE44 5001 0517 5407 3249 31", ["123-45-6789", "5001 0517"], 2),
        ("2001:db8:85a3::8a2e:370:7334 at 12:34:56", ["85a3"], 1),
        ("030 1234567 oder jösé@corp.com", ["1234567", "jösé", "corp.com"], 2),
        ("4111111111111111 but 1234567890123456", ["4111111111111111"], 1),
        ("key 0123456789abcdef0123456789abcdef", ["0123456789abcdef0123456789abcdef"], 1),
        ("我见到王伟先生", ["王伟"], 1),
        ("11111111111111111111111111111111, pi 3.14159, 2020-01-02 and John", [], 0),
    ],
)
def test_personal_data_by_kind(spark, text, gone, n):
    got = pii.replace(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, k1 int"), "secret").first()
    assert got.n_mentions == n and got.k1 == 5 and not any(x in got.text for x in gone)
    assert sum(c.isdigit() for c in got.text) == sum(c.isdigit() for c in text) or "@" in text or ":" in text or "key" in text or "IBAN" in text
    assert n or got.text == text


def test_surrogates_are_distinct_and_hang_on_the_key(spark):
    texts = [f"Mr {chr(65 + i)}{chr(97 + j)}nov called +1 ({200 + i}) 555-{1000 + j}" for i in range(20) for j in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = ({r.doc_id: r.text for r in pii.replace(docs, k).collect()} for k in ("a", "b"))
    names = {t: one[i].split()[1] for i, t in enumerate(texts)}
    assert len(set(names.values())) == len({t.split()[1] for t in texts}) and not {t.split()[1] for t in texts} & set(names.values())
    assert sum(one[i] == two[i] for i in one) == 0
    with pytest.raises(ValueError):
        pii.replace(docs, "")


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><article class="post comments-open"><p>one two three four five six seven</p></article>', "one two three four five six seven"),
        ('<div class="content-with-sidebar"><article><p>one two three four five six seven eight</p></article></div>', "one two three four five six seven eight"),
        ('<div class="comments"><article><p>a remark by some reader that is long enough</p></article></div>', ""),
        ('<div class="cookie-banner"><p>we use cookies on this page to please you and us</p></div>', ""),
        ("<article>" + "<p>some words that stand in a row here</p>" * 5000 + "</article>", "\n".join(["some words that stand in a row here"] * 5000)),
    ],
)
def test_extract_reads_whole_class_names(page, want):
    assert extract.main_text(page) == want


def test_proximity_by_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(30)) + (" rare1 x x x rare2" if i % 3 == 0 else " rare1" + " y" * 30 + " rare2")) for i in range(12)]
    items = [(7, "rare1 alpha rare2")]
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=5)
    want = {d for d, t in docs if abs(t.split().index("rare1") - t.split().index("rare2")) <= 5}
    assert {r.doc_id for r in got.collect()} == want and want


CLASHING = "doc_id long, text string, source string, text_id long, row string, k1 long, size int, hash long, removed string, names string, c0 string, copies int"
EDGES = [(1, None, None), (2, "", "a"), (3, "one two three four five six seven", "a"), (4, "one two three four five six seven", "a"), (4, "one two three four five six seven", "a"), (5, "x" * 5000 + " tail " + "word " * 30000, None), (6, " \n\n ", "b"), (None, "one two three four five six seven", "b")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 1, "r", 2, 3, 4, "g", "n", "c", 9) for r in EDGES], CLASHING)


def test_edges_of_line_dedup(edges):
    got = Counter((r.doc_id, r.text, r.removed_lines, r.row, r.c0) for r in linededup.deduplicate(edges).collect())
    assert sum(got.values()) == len(EDGES) and got[4, "", 1, "r", "c"] == 2 and got[1, None, 0, "r", "c"] == 1
    assert got[None, EDGES[2][1], 0, "r", "c"] == 1 and got[6, " \n\n ", 0, "r", "c"] == 1
    assert linededup.deduplicate(edges.limit(0)).count() == 0


def test_edges_of_near_dedup_and_mix(edges):
    kept = simhash.keep_one(edges)
    assert set(kept.columns) == set(edges.columns) and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5]
    mixed = mixing.select(edges)
    assert sorted(mixed.columns) == sorted(edges.columns) and {r.doc_id for r in mixed.collect()} <= {3, 4, 5, None}
    assert mixing.select(edges.limit(0)).count() == 0 == simhash.keep_one(edges.limit(0)).count()


def test_edges_of_decontamination_and_pii(spark, edges):
    items = spark.createDataFrame([(1, "two three four five"), (2, None), (3, "")], "item_id long, text string")
    kept = decontaminate.keep(edges, items)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert decontaminate.keep(edges.limit(0), items).count() == 0 and decontaminate.keep(edges, items.limit(0)).count() == len(EDGES)
    assert pii.replace(edges, "k").filter("n_mentions > 0").count() == 0 == pii.replace(edges.limit(0), "k").count()


def test_edges_of_classifiers(spark, edges):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 7)] + [(None, 1, 1), (3, None, None), (99, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score(edges, labels).count() == len(EDGES) and module.score(edges.limit(0), labels).count() == 0
        assert {r.score for r in module.score(edges, labels.limit(0)).collect()} == {0.5}
    assert quality.keep(edges, labels).columns == edges.columns


def test_edges_of_neighbours_and_pages(spark):
    v = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (20, [1.0, 1e-12]), (7, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [1.0])]
    got = ann.search(spark.createDataFrame([(*r, 0) for r in v], "vec_id long, embedding array<double>, part int"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(20, 1, 1), (20, 2, 7), (20, 3, 7)] and got[2].score == 0.5 + 0.5 * 1e-12
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", "", 1), (2, None, "<p>a", 1)], "page_id long, url string, html string, row int")
    assert extract.extract(pages, page_id="page_id", url="url").count() == 3 and extract.extract(pages.limit(0), page_id="page_id").count() == 0


def test_pipeline_by_stage(spark, sf_dir):
    """Each stage against its own brute-force rule on what the last one kept; run() gives the stages' rows."""
    docs = read(spark, sf_dir, "documents")
    items = [" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())) for r in read(spark, sf_dir, "benchmark").collect()]
    windows = {" ".join(w[i : i + 8]) for w in map(str.split, items) for i in range(max(1, len(w) - 7)) if w}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == read(spark, sf_dir, "documents").columns and set(after) <= set(before), name
        if name == "quality":
            scores = {r.doc_id: r.score for r in queries.op8_quality(spark, sf_dir).collect()}
            assert set(after) == {d for d in before if scores[d] >= 0.3}
        elif name == "line_dedup":
            assert set(after) == set(before)
            for d, r in after.items():  # lines go, in order, and none is altered
                left = iter((before[d].text or "").split("\n"))
                assert not r.text or all(line in left for line in r.text.split("\n"))
        elif name == "near_dedup":
            prints = {d: simhash.fingerprint((r.text or "").encode()) for d, r in before.items()}
            root = {d: d for d in before}
            for a in sorted(root):
                for b in sorted(root):
                    if a < b and root[a] != root[b] and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3:
                        x, y = sorted((root[a], root[b]))
                        root = {d: x if r == y else r for d, r in root.items()}
            assert set(after) == set(root.values())
        else:
            word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            hit = {d for d, r in before.items() if any(f" {w} " in " " + " ".join(word(r.text)) + " " for w in windows)}
            assert set(after) == set(before) - hit
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.copies) for r in last.collect())
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    assert {r.doc_id: r.copies for r in last.collect()} == {r.doc_id: taken[r.doc_id] // len(r.text.encode().split()) for r in docs.collect() if taken[r.doc_id]}
