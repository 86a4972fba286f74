"""The engine's own operators: against DuckDB on the smallest tables, and on literals."""

import os

import duckdb
import pytest

from lexiquarry.functions import stemmer
from lexiquarry.operators import dynamic
from lexiquarry.plans import catalog

CHECKED = ["lines_split", "term_frequency", "idf_table", "bm25_topk", "cosine_topk", "lm_dirichlet_topk", "mean_average_precision", "single_index", "special_hyphen", "special_date", "phrase_filtered", "phrase_cross_line", "proximity_pairs", "doc_term_matrix", "kmeans_assign", "trec_parse", "run_format"]


def rows(frame):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert len(want) > 0
    assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == rows(want)


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("adjustment", "adjust")])
def test_stem(word, stem):
    assert stemmer.stem(word) == stem


def test_scan_of_two_terms_is_the_least_distance():
    assert dynamic.scan_hit([[1, 40], [56]], 15) is False
    assert dynamic.scan_hit([[1, 41], [55]], 15) is True
    assert dynamic.scan_hit([[20], [0, 30], [10]], 15) is True


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
