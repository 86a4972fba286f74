"""Cosine K-Means and search that looks at selected clusters only.

Vectors are (id, vec) with vec an array of doubles. Centroids are a table of K
rows; K is a parameter, so broadcasting them is bounded. Vectors without length
take no part. Ties go to the lowest cluster; an empty cluster keeps its centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiquarry.operators.staging import written

MAX_ITER = 20
TOLERANCE = 1e-6
#: Members and queries of a cell that one task multiplies, and the queries it takes at a time.
MEMBERS, ASKING, AT_ONCE = 32_768, 2_048, 64
#: By how much a similarity may lie below the k-th best and still be rounded to it.
ROUNDING = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).filter(norm(F.col("vec")) > 0)


def seeds(vectors: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """(cluster, centroid): the k smallest ids, or k at random for a seed."""
    order = [F.xxhash64(F.lit(seed), F.col("id")), F.col("id")] if seed is not None else [F.col("id")]
    chosen = vectors.orderBy(*order).limit(k)
    return chosen.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("vec").alias("centroid"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, vec, cluster, sim): the nearest centroid; K products a vector, all in its own task."""
    listed = centroids.filter(norm(F.col("centroid")) > 0).agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("all"))
    scored = vectors.crossJoin(F.broadcast(listed)).select("id", "vec", F.transform("all", lambda c: F.struct(F.round(cosine(F.col("vec"), c["centroid"]), 12).alias("sim"), (-c["cluster"]).alias("c"))).alias("s"))
    best = F.array_max("s")
    return scored.select("id", "vec", (-best["c"]).alias("cluster"), best["sim"].alias("sim"))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, centroid): component means of the members."""
    parts = assigned.select("cluster", F.posexplode("vec").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    means = parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p")).select("cluster", F.col("p.x").alias("mean"))
    return centroids.join(means, "cluster", "left").select("cluster", F.coalesce("mean", "centroid").alias("centroid"))


def cohesion(assigned: DataFrame) -> DataFrame:
    """(cluster, size, cohesion): the sum of the members' similarities to their centroid."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("sim").alias("cohesion"))


def kmeans(vectors: DataFrame, k: int, centroids: DataFrame | None = None, max_iter: int = MAX_ITER, compat: bool = False, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assignments and centroids when the summed similarity gains no more.

    ``compat`` stops as soon as the sum doesn't fall, which usually means after the
    second round. A round is one job: what reaches the driver are K times dimension sums.
    """
    rows = written(usable(vectors).withColumn("parent", F.lit(0)), "vectors")
    first = seeds(rows.select("id", "vec"), k, seed) if centroids is None else centroids
    used, centres = _rounds(rows, {0: {r["cluster"]: list(r["centroid"]) for r in first.collect()}}, max_iter, compat)
    assigned = nearest(rows, used if compat else centres).drop("parent")
    return assigned, _table(vectors.sparkSession, centres).drop("parent")


def _table(spark, centres: dict[int, dict[int, list[float]]]) -> DataFrame:
    rows = [(p, c, [float(x) for x in v]) for p, own in sorted(centres.items()) for c, v in sorted(own.items())]
    return spark.createDataFrame(rows, "parent int, cluster int, centroid array<double>")


def _rounds(rows: DataFrame, centres: dict[int, dict[int, list[float]]], max_iter: int = MAX_ITER, compat: bool = False) -> tuple[dict, dict]:
    """K-Means of each parent's rows (id, vec, parent), all parents in the same jobs, each until it gains no more: the centroids before the last move, and after it."""
    previous = {p: 99999.0 if compat else None for p in centres}
    used, moved = {p: dict(own) for p, own in centres.items()}, {p: dict(own) for p, own in centres.items()}
    live = set(centres)
    for _ in range(max_iter):
        used |= {p: dict(moved[p]) for p in live}
        for p, total in _move(rows.filter(F.col("parent").isin(*sorted(live))), moved, live).items():
            before = previous[p]
            if before is not None and (total >= before if compat else total - before <= TOLERANCE * abs(before)):
                live.discard(p)
            previous[p] = total
        if not live:
            break
    return used, moved


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _even(frame: DataFrame, column: str) -> int | None:
    """The length that all of the column's arrays have; null if they differ."""
    row = frame.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).first()
    return row["least"] if row["least"] == row["most"] else None


def _nearest(vecs: np.ndarray, own: dict[int, list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid's cluster of each row, of equal ones the lowest; the similarity to it; the rows' lengths."""
    named = [c for c in sorted(own) if any(own[c])]
    centres = np.array([own[c] for c in named], float)
    lengths = np.sqrt((vecs * vecs).sum(axis=1))
    sims = np.round(vecs @ centres.T / (lengths[:, None] * np.sqrt((centres * centres).sum(axis=1))), 12)
    best = sims.argmax(axis=1)
    return np.array(named, np.int32)[best], sims[np.arange(len(vecs)), best], lengths


def nearest(rows: DataFrame, centres: dict[int, dict[int, list[float]]]) -> DataFrame:
    """(id, vec, parent, cluster, sim) of (id, vec, parent): the nearest of the parent's centroids."""
    if _even(rows, "vec") is None:
        parts = [assign(rows.filter(F.col("parent") == p), _table(rows.sparkSession, {p: own})).withColumn("parent", F.lit(p)) for p, own in sorted(centres.items())]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select("id", "vec", "parent", "cluster", "sim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, parents = _matrix(batch.column(1)), batch.column(2).to_numpy()
            cluster, sim = np.zeros(len(vecs), np.int32), np.zeros(len(vecs))
            for p in np.unique(parents):
                at = np.flatnonzero(parents == p)
                cluster[at], sim[at], _ = _nearest(vecs[at], centres[int(p)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cluster), pa.array(sim)], names=["id", "vec", "parent", "cluster", "sim"])

    narrow = rows.select("id", "vec", F.col("parent").cast("int").alias("parent"))
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("sim", T.DoubleType())]))


def _move(rows: DataFrame, centres: dict[int, dict[int, list[float]]], live: set[int]) -> dict[int, float]:
    """Move each centroid of the ``live`` parents to its members' mean; returns each parent's summed similarity of members to it.

    The sum of cosines with one centroid is its product with the sum of the members' unit vectors. What reaches
    the driver are, for each partition, the sums of each centroid's members.
    """
    if _even(rows, "vec") is None:
        return _move_uneven(rows, centres, live)
    asked = {p: dict(centres[p]) for p in live}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, parents = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for p in np.unique(parents):
                at = parents == p
                own = vecs[at]
                cluster, _, lengths = _nearest(own, asked[int(p)])
                for c in np.unique(cluster):
                    one = cluster == c
                    found = sums.setdefault((int(p), int(c)), [0, 0.0, 0.0])
                    found[0] += int(one.sum())
                    found[1] = found[1] + own[one].sum(axis=0)
                    found[2] = found[2] + (own[one] / lengths[one][:, None]).sum(axis=0)
        if sums:
            keys = list(sums)
            columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([sums[k][i] if i == 0 else sums[k][i].tolist() for k in keys]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["parent", "cluster", "n", "sums", "units"])

    found: dict[tuple[int, int], list] = {}
    for r in rows.select("vec", F.col("parent").cast("int").alias("parent")).mapInArrow(run, "parent int, cluster int, n long, sums array<double>, units array<double>").collect():
        own = found.setdefault((r["parent"], r["cluster"]), [0, 0.0, 0.0])
        own[0], own[1], own[2] = own[0] + r["n"], own[1] + np.array(r["sums"]), own[2] + np.array(r["units"])
    totals = dict.fromkeys(live, 0.0)
    for (p, c), (n, total, unit) in found.items():
        mean = total / n
        centres[p][c] = mean.tolist()
        length = float(np.sqrt(mean @ mean))
        totals[p] += float(mean @ unit) / length if length else 0.0
    return totals


def _move_uneven(rows: DataFrame, centres: dict[int, dict[int, list[float]]], live: set[int]) -> dict[int, float]:
    """``_move`` for vectors of different lengths."""
    each = nearest(rows, {p: centres[p] for p in live}).select("parent", "cluster", norm(F.col("vec")).alias("n"), F.posexplode("vec").alias("pos", "x"))
    sums = each.groupBy("parent", "cluster", "pos").agg(F.avg("x").alias("mean"), F.sum(F.col("x") / F.col("n")).alias("unit")).orderBy("parent", "cluster", "pos").collect()
    means: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for r in sums:
        means.setdefault((r["parent"], r["cluster"]), []).append((r["mean"], r["unit"]))
    totals = dict.fromkeys(live, 0.0)
    for (p, c), own in means.items():
        centres[p][c] = [m for m, _ in own]
        length = sum(m * m for m, _ in own) ** 0.5
        totals[p] += sum(m * u for m, u in own) / length if length else 0.0
    return totals


def interclass(centroids: DataFrame) -> DataFrame:
    """One row: the mean similarity of centroid pairs."""
    a, b = centroids.select(F.col("cluster").alias("i"), F.col("centroid").alias("a")), centroids.select(F.col("cluster").alias("j"), F.col("centroid").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j")).filter((norm(F.col("a")) > 0) & (norm(F.col("b")) > 0))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.avg(cosine(F.col("a"), F.col("b"))), 2).alias("interclass"))


def intraclass(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, intraclass): the mean similarity of members to their centroid."""
    pairs = assigned.select("vec", "cluster").join(F.broadcast(centroids), "cluster").filter(norm(F.col("centroid")) > 0)
    return pairs.groupBy("cluster").agg(F.round(F.avg(cosine(F.col("vec"), F.col("centroid"))), 2).alias("intraclass"))


def routes(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, cluster, place): clusters by similarity of their centroid, best first, from 1."""
    return _routed(queries.select("query_id", "vec"), centroids.select("cluster", "centroid"))


def _routed(queries: DataFrame, centroids: DataFrame, *own: str) -> DataFrame:
    """``routes``; a query looks only at centroids with the same values of the columns ``own``."""
    q = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), *own).filter(norm(F.col("vec")) > 0)
    pairs = (q.join(F.broadcast(centroids), list(own)) if own else q.crossJoin(F.broadcast(centroids))).filter(norm(F.col("centroid")) > 0)
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "cluster")
    scored = pairs.select("query_id", "cluster", F.round(cosine(F.col("vec"), F.col("centroid")), 6).alias("sim"))
    return scored.withColumn("place", F.row_number().over(order))


def search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, least: int = 100, k: int = 100, split_over: int | None = None) -> DataFrame:
    """(query_id, id, rank, score): clusters are searched in order until ``least`` candidates are there.

    With ``split_over``, clusters with more members are clustered again, once each,
    into three quarters as many; a query then looks at the parts of its first cluster.
    """
    members, centroids = written(assigned.select("id", "vec", "cluster"), "members"), written(centroids, "centroids")
    if split_over is not None:
        return _search_split(queries, members, centroids, least, k, split_over)
    return _searched(queries, routes(queries, centroids), members, least, k)


def _searched(queries: DataFrame, routed: DataFrame, members: DataFrame, least: int, k: int) -> DataFrame:
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    before = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ordered = routed.join(F.broadcast(sizes), "cluster").withColumn("had", F.coalesce(F.sum("size").over(before), F.lit(0)))
    q = queries.select("query_id", F.col("vec").cast("array<double>").alias("q"))
    asking = written(ordered.filter(F.col("had") < least).select("query_id", "cluster").join(q, "query_id"), "asking")
    scored = _scored(asking, members, k).select("query_id", "id", F.round("score", 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", (F.col("rank") - 1).alias("rank"), "score")


def _scored(asking: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each query's (query_id, cluster, q) clusters all that may be among its k best.

    Every query meets every member, in cells of a bounded number of both, each a product of matrices;
    from a cell come the k best and those that may be rounded to the k-th.
    """
    lengths = {_even(asking, "q"), _even(members, "vec")}
    if len(lengths - {None}) != 1 or None in lengths:
        return asking.join(members, "cluster").select("query_id", "id", cosine(F.col("q"), F.col("vec")).alias("score"))
    parts = members.groupBy("cluster").agg((F.floor((F.count("*") - 1) / MEMBERS) + 1).alias("of_members")).join(asking.groupBy("cluster").agg((F.floor((F.count("*") - 1) / ASKING) + 1).alias("of_asking")), "cluster")
    parts = F.broadcast(written(parts, "parts"))  # a row a cluster
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = asking.join(parts, "cluster").select("cluster", every("of_members").alias("m"), dealt("query_id", "of_asking").alias("a"), "query_id", "q")
    right = members.join(parts, "cluster").select("cluster", dealt("id", "of_members").alias("m"), every("of_asking").alias("a"), "id", "vec")
    schema = T.StructType([asking.schema["query_id"], members.schema["id"], T.StructField("score", T.DoubleType())])

    def met(asked: pa.Table, own: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not asked.num_rows or not own.num_rows:
            return pa.table([asked["query_id"].slice(0, 0), own["id"].slice(0, 0), pa.array([], pa.float64())], names=names)
        ids = own["id"].combine_chunks()
        unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
        a, b = (unit(_matrix(x.combine_chunks())) for x in (asked["q"], own["vec"]))
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rows, found, scores = [], [], []
        for start in range(0, len(a), AT_ONCE):
            sims = a[start : start + AT_ONCE] @ b.T
            floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k] - ROUNDING if sims.shape[1] > k else np.full(len(sims), -np.inf)
            at, member = np.nonzero(sims >= floor[:, None])
            own_sims = sims[at, member]
            # Of equal similarities the k smallest ids do.
            order = np.lexsort((by_id[member], -own_sims, at))
            at, member, own_sims = at[order], member[order], own_sims[order]
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (own_sims[1:] != own_sims[:-1])))
            begun = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            keep = np.arange(len(at)) - begun < k
            rows.append(at[keep] + start)
            found.append(member[keep])
            scores.append(own_sims[keep])
        return pa.table([asked["query_id"].combine_chunks().take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], names=names)

    n = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["cluster", "m", "a"]
    return left.repartition(n, *cell).groupBy(*cell).cogroup(right.repartition(n, *cell).groupBy(*cell)).applyInArrow(met, schema)


def _search_split(queries: DataFrame, members: DataFrame, centroids: DataFrame, least: int, k: int, split_over: int) -> DataFrame:
    n = centroids.count()
    first = written(routes(queries, centroids).filter("place = 1").select("query_id", "cluster"), "first")
    large = sorted(r["cluster"] for r in members.groupBy("cluster").count().filter(F.col("count") > split_over).collect())  # K rows at most
    usual = queries.join(first.filter(~F.col("cluster").isin(large)), "query_id", "left_semi") if large else queries
    out = _searched(usual, routes(usual, centroids), members, least, k)
    if not large:
        return out
    parts = max(1, int(n * 0.75))
    rows = written(members.filter(F.col("cluster").isin(large)).select("id", "vec", F.col("cluster").cast("int").alias("parent")), "large")
    order = Window.partitionBy("parent").orderBy("id")
    centres: dict[int, dict[int, list[float]]] = {}
    for r in rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= parts).collect():  # parts of K at most
        centres.setdefault(r["parent"], {})[r["i"] - 1] = list(r["vec"])
    _, moved = _rounds(rows, centres)
    named = lambda: (F.col("parent") * parts + F.col("cluster")).alias("cluster")
    own = written(nearest(rows, moved).select("id", "vec", named()), "parts")
    asked = queries.join(first.filter(F.col("cluster").isin(large)).withColumnRenamed("cluster", "parent"), "query_id")
    routed = _routed(asked.select("query_id", "vec", "parent"), _table(queries.sparkSession, moved).select("parent", named(), "centroid"), "parent")
    return out.unionByName(_searched(asked.select("query_id", "vec"), routed, own, least, k))
