"""DuckDB SQL for the registered queries, put together from the same fixed values as the plans."""

from __future__ import annotations

from lexiquarry.functions import special, text
from lexiquarry.functions.stops import STOP_WORDS

K1, K2, B = "1.2e0", "700e0", "0.75e0"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


STOPS = listed(STOP_WORDS)


def normal(t: str) -> str:
    return f"trim(replace(lower({t}), ',', ''), {lit(text.PUNCTUATION)})"


def tokens(column: str) -> str:
    return f"list_filter(list_transform(string_split_regex({column}, {lit(text.SEPARATORS)}), lambda t: {normal('t')}), lambda t: t <> '')"


def terms(column: str) -> str:
    return f"list_filter({tokens(column)}, lambda t: NOT list_contains({STOPS}, t))"


def lines(column: str) -> str:
    return f"list_filter(string_split_regex({column}, {lit(text.LINE_ENDS)}), lambda x: x <> '')"


def decoded(line: str) -> str:
    out = line
    for name, sign in text.ESCAPES:
        out = f"replace({out}, {lit(name)}, {lit(sign)})"
    return f"CASE WHEN regexp_matches({line}, '&[a-z]+;') THEN {out} ELSE {line} END"


def edged(pattern: str) -> str:
    """The pattern with DuckDB's word edges, which look at ASCII alone, in place of lookarounds."""
    return pattern.replace(special.BEFORE, r"\b").replace(special.AFTER, r"\b")


def every(line: str, pattern: str) -> str:
    return f"regexp_extract_all({line}, {lit(edged(pattern))})"


PLAIN = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY term, doc_id"
PLAIN_ASKED = f"SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY query_id, term"


def weighted(post: str = PLAIN, asked: str = PLAIN_ASKED) -> str:
    """Postings, their statistics and the topics' terms as common table expressions."""
    return f"""
post AS ({post}),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS doc_len FROM post GROUP BY doc_id),
col AS (SELECT count(*)::BIGINT AS n_docs, sum(doc_len)::BIGINT AS n_tokens, sum(doc_len)::DOUBLE / count(*) AS avg_len FROM dl),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, log10(any_value(n_docs)::DOUBLE / count(*)) AS idf FROM post, col GROUP BY term),
norms AS (SELECT doc_id, sum(tf)::BIGINT AS doc_len, sum(pow(tf * idf, 2)) AS doc_norm2 FROM post JOIN terms USING (term) GROUP BY doc_id),
q AS ({asked})
"""


POSTINGS = weighted()

SCORES = {
    "bm25": f"""SELECT query_id, doc_id, sum(ln((n_docs - df + 0.5e0) / (df + 0.5e0)) * (({K1} + 1) * tf / ({K1} * ((1 - {B}) + {B} * doc_len / avg_len) + tf)) * (({K2} + 1) * qtf / ({K2} + qtf))) AS score
FROM q JOIN post USING (term) JOIN terms USING (term) JOIN dl USING (doc_id), col GROUP BY query_id, doc_id""",
    "cosine": """SELECT query_id, doc_id, dot / sqrt(doc_norm2 * query_norm2) AS score FROM
(SELECT query_id, doc_id, sum(tf * idf * qtf * idf) AS dot FROM q JOIN post USING (term) JOIN terms USING (term) GROUP BY query_id, doc_id)
JOIN (SELECT query_id, sum(pow(qtf * idf, 2)) AS query_norm2 FROM q JOIN terms USING (term) GROUP BY query_id) USING (query_id) JOIN norms USING (doc_id) WHERE doc_norm2 > 0 AND query_norm2 > 0""",
    "lm": """SELECT query_id, doc_id, sum(ln((coalesce(tf, 0) + avg_len * cf / n_tokens) / (doc_len + avg_len))) AS score
FROM q JOIN terms USING (term) CROSS JOIN dl CROSS JOIN col LEFT JOIN post USING (term, doc_id) GROUP BY query_id, doc_id""",
}


def ranked(scores: str, k: int) -> str:
    return f"SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM ({scores}))) WHERE rank < {k}"


def topk(model: str, k: int = 100) -> str:
    return f"WITH {POSTINGS} {ranked(SCORES[model], k)}"


QRELS = "qrels AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))"

MEASURES = f"""WITH {POSTINGS}, run AS ({ranked(SCORES["bm25"], 100)}), {QRELS},
total AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
marked AS (SELECT r.query_id, r.rank, n_rel, (x.doc_id IS NOT NULL)::INT AS rel, sum((x.doc_id IS NOT NULL)::INT) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS found
  FROM run r JOIN total t ON t.query_id = r.query_id LEFT JOIN qrels x ON x.query_id = r.query_id AND x.doc_id = r.doc_id),
own AS (SELECT query_id, sum(CASE WHEN rank < 10 THEN rel ELSE 0 END) AS at_k, sum(CASE WHEN rel = 1 THEN found::DOUBLE / (rank + 1) ELSE 0e0 END) AS precisions,
  min(CASE WHEN rel = 1 THEN rank + 1 END) AS first, sum(CASE WHEN rank < n_rel THEN rel ELSE 0 END) AS at_r FROM marked GROUP BY query_id),
measures AS (SELECT query_id, coalesce(at_k / 10e0, 0e0) AS precision_at_k, coalesce(at_k::DOUBLE / n_rel, 0e0) AS recall_at_k, coalesce(precisions / n_rel, 0e0) AS average_precision,
  coalesce(1e0 / first, 0e0) AS reciprocal_rank, coalesce(at_r::DOUBLE / n_rel, 0e0) AS r_precision FROM total LEFT JOIN own USING (query_id))"""


def measure(name: str) -> str:
    return f"{MEASURES} SELECT query_id, round({name}, 6) AS {name} FROM measures"


# Special tokens: each rule's tokens as a list, from a line.


def _dates(line: str) -> str:
    month = f"CASE WHEN regexp_matches(m, '^[A-Z]') THEN list_position({listed(special.MONTH_NUMBERS)}, lower(m[1:3])) ELSE try_cast(regexp_extract(m, '^(\\d+)', 1) AS INT) END"
    day = "try_cast(CASE WHEN regexp_matches(m, '^[A-Z]') THEN regexp_extract(m, '\\s(\\d+),', 1) ELSE regexp_extract(m, '^\\d+[/-](\\d+)', 1) END AS INT)"
    year = "try_cast(CASE WHEN regexp_matches(m, '^[A-Z]') THEN regexp_extract(m, ',\\s(\\d+)$', 1) ELSE regexp_extract(m, '(\\d+)$', 1) END AS INT)"
    parts = f"list_transform({every(line, special.DATE)}, lambda m: {{'m': {month}, 'd': {day}, 'y': {year}}})"
    full = f"list_transform({parts}, lambda p: {{'m': p.m, 'd': p.d, 'y': CASE WHEN p.y BETWEEN 10 AND 18 THEN p.y + 2000 WHEN p.y BETWEEN 19 AND 99 THEN p.y + 1900 ELSE p.y END}})"
    longest = "CASE WHEN p.m = 2 THEN 29 WHEN p.m IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    good = f"list_filter({full}, lambda p: coalesce(p.m BETWEEN 1 AND 12 AND p.d BETWEEN 1 AND {longest} AND p.y BETWEEN 1918 AND 2018, false))"
    return f"list_transform({good}, lambda p: lpad(p.m::VARCHAR, 2, '0') || '-' || lpad(p.d::VARCHAR, 2, '0') || '-' || p.y::VARCHAR)"


def _hyphenated(line: str) -> str:
    split = "string_split(h, '-')"
    first, second = f"{split}[1]", f"{split}[2]"
    letters, digits = "'^\\p{L}+$'", "'^\\p{N}+$'"
    own = (
        f"CASE WHEN len({split}) = 2 AND regexp_matches({first}, {letters}) AND regexp_matches({second}, {digits}) THEN CASE WHEN length({first}) >= 3 THEN [{normal(first)}] ELSE [] END "
        f"WHEN len({split}) = 2 AND regexp_matches({first}, {digits}) AND regexp_matches({second}, {letters}) THEN CASE WHEN length({second}) >= 3 THEN [{second}] ELSE [] END "
        f"WHEN list_contains({listed(special.PREFIXES)}, {first}) THEN [{second}] ELSE list_filter({split}, lambda s: NOT list_contains({STOPS}, s)) END"
    )
    found = f"list_concat({own}, [replace(h, '-', '')])"
    each = f"list_transform(list_transform({every(line, special.HYPHEN)}, lambda m: {normal('m')}), lambda h: list_filter({found}, lambda s: s IS NOT NULL AND s <> ''))"
    return f"flatten({each})"


FOUND = {
    "email": lambda x: f"list_transform({every(x, special.EMAIL)}, lambda m: {normal('m')})",
    "ip": lambda x: f"list_transform({every(x, special.IP)}, lambda m: {normal('m')})",
    "acronym": lambda x: f"list_transform({every(x, special.ACRONYM)}, lambda m: replace({normal('m')}, '.', ''))",
    "date": _dates,
    "decimal": lambda x: f"list_transform({every(x, special.DECIMAL)}, lambda m: regexp_extract(m, '([§$])\\d', 1) || round_even(regexp_extract(m, '(\\d+\\.\\d+)$', 1)::DOUBLE, 0)::BIGINT::VARCHAR)",
    "hyphen": _hyphenated,
    "url": lambda x: every(x, special.URL),
    "filename": lambda x: f"list_transform({every(x, special.FILE)}, lambda m: lower(m))",
}


#: Topics as lines, under the names that documents' lines have.
TOPIC_LINES = "lines AS (SELECT item_id AS doc_id, 0 AS line_no, text AS line FROM benchmark)"


def special_lines(extra: list[tuple[int, str]]) -> str:
    if not extra:
        return f"lines AS (SELECT doc_id, 0 AS line_no, unnest({lines('text')}) AS line FROM documents)"
    rows = ", ".join(f"({i}, 0, {lit(x)})" for i, x in extra)
    return f"lines AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, {lines('text')} AS l FROM documents) UNION ALL SELECT * FROM (VALUES {rows})))"


def special_found(name: str, extra: list[tuple[int, str]]) -> str:
    return f"WITH {special_lines(extra)}, found AS (SELECT doc_id, line_no, {FOUND[name]('line')} AS tokens FROM lines) SELECT doc_id, line_no, array_to_string(tokens, ' ') AS tokens FROM found WHERE len(tokens) > 0"


def single_index(source: str) -> str:
    steps, rest = [f"d0 AS (SELECT doc_id, {decoded('line')} AS rest FROM lines)"], []
    for i, (name, pattern, _) in enumerate(special.RULES):
        steps.append(f"d{i + 1} AS (SELECT doc_id, {FOUND[name]('rest')} AS f{i}{''.join(rest)}, regexp_replace(rest, {lit(edged(pattern))}, '', 'g') AS rest FROM d{i})")
        rest.append(f", f{i}")
    found = "f0"
    for i in range(1, len(special.RULES)):
        found = f"list_concat({found}, f{i})"
    return f"WITH {source}, {', '.join(steps)} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat({found}, {terms('rest')})) AS term FROM d{len(special.RULES)}) WHERE term <> '' GROUP BY term, doc_id"


# Phrases.

FLAGGED = f"""split AS (SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, {lines("text")} AS l FROM documents)),
found AS (SELECT doc_id, line_no, list_transform(regexp_extract_all({decoded("line")}, {lit(text.PHRASE_TOKEN)}), lambda t: lower(t)) AS t FROM split),
flagged AS (SELECT doc_id, line_no, t, list_transform(t, lambda x: NOT list_contains({STOPS}, x) AND NOT list_contains({listed(text.PHRASE_SIGNS)}, x)) AS ok FROM found WHERE len(t) > 0)"""


def windows(source: str, key: str, less: int) -> str:
    pair = "t[i] || ' ' || t[i + 1]"
    return f"SELECT {key}, unnest(CASE WHEN coalesce(ok[i + 2], false) THEN [{pair}, {pair} || ' ' || t[i + 2]] ELSE [{pair}] END) AS phrase FROM (SELECT *, unnest(range(1, len(t) - {less} + 2)) AS i FROM {source}) WHERE ok[i] AND coalesce(ok[i + 1], false)"


INSIDE = f"inside AS ({windows('flagged', 'doc_id, line_no', 3)})"
CROSSING = """edges AS (SELECT doc_id, line_no, t, ok, lag(CASE WHEN coalesce(ok[len(t) - 1], false) AND ok[len(t)] THEN [t[len(t) - 1], t[len(t)]] WHEN ok[len(t)] THEN [t[len(t)]] ELSE [] END) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM flagged),
crossing AS (SELECT doc_id, line_no, array_to_string(c, ' ') || ' ' || t[1] AS phrase FROM edges WHERE len(c) > 0 AND ok[1]
  UNION ALL SELECT doc_id, line_no, c[len(c)] || ' ' || t[1] || ' ' || t[2] FROM edges WHERE len(c) > 0 AND ok[1] AND coalesce(ok[2], false))"""
PHRASES = f"{FLAGGED}, {INSIDE}, {CROSSING}, phrases AS (SELECT doc_id, phrase FROM inside UNION ALL SELECT doc_id, phrase FROM crossing)"
ASKED = f"""qt AS (SELECT item_id AS query_id, list_transform(regexp_extract_all({decoded("text")}, {lit(text.PHRASE_TOKEN)}), lambda t: lower(t)) AS t FROM benchmark),
qf AS (SELECT query_id, t, list_transform(t, lambda x: NOT list_contains({STOPS}, x) AND NOT list_contains({listed(text.PHRASE_SIGNS)}, x)) AS ok FROM qt WHERE len(t) > 1),
asked AS ({windows("qf", "query_id", 2)})"""

POSITIONS = f"placed AS (SELECT doc_id, generate_subscripts(t, 1) AS place, unnest(t) AS term FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)), pos AS (SELECT term, doc_id, count(*) AS tf, list(place ORDER BY place) AS positions FROM placed GROUP BY term, doc_id)"
#: Documents that hold all terms of a phrase, with their lists in the order of the terms.
LISTS = f"""{ASKED}, wanted AS (SELECT key, generate_subscripts(s, 1) AS place, unnest(s) AS term FROM (SELECT DISTINCT phrase AS key, string_split(phrase, ' ') AS s FROM asked)), {POSITIONS},
need AS (SELECT key, count(*) AS need FROM wanted GROUP BY key),
lists AS (SELECT key, doc_id, list(positions ORDER BY place) AS lists FROM wanted JOIN pos USING (term) JOIN need USING (key) GROUP BY key, doc_id HAVING count(*) = any_value(need))"""

# Vectors.

COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def clusters(k: int) -> str:
    near = f"round({cos('vec', 'centroid')}, 12)"
    return f"""vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
seeds AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster, vec AS centroid FROM (SELECT * FROM vectors ORDER BY id LIMIT {k})),
assigned AS (SELECT id, vec, cluster, sim FROM (SELECT id, vec, cluster, {near} AS sim, row_number() OVER (PARTITION BY id ORDER BY {near} DESC, cluster) AS r FROM vectors, seeds) WHERE r = 1),
centres AS (SELECT cluster, list(x ORDER BY pos) AS centroid FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM assigned) GROUP BY cluster, pos) GROUP BY cluster)"""
