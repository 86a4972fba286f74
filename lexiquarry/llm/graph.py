"""Connected components of a link table, by alternating star contractions.

Each round is two aggregations and two joins over the links; the number of
links never grows, so memory is bounded by partitions and no group of
neighbours is ever gathered in one place. Rounds are staged in the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import staged

MAX_ROUNDS = 60


def _oriented(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link and isn't its group's smallest.

    ``links`` holds two long columns. Loops and repeated links do no harm; rows
    with a null end are ignored; no links give no rows.
    """
    edges = staged(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*_oriented(a, b)).distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(nearest, "u")
        small = joined.filter("v <> m").select(*_oriented("v", "m")).unionByName(nearest.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
