"""Nearest neighbours by inner product: anisotropic four-bit quantisation and exact reranking.

The index has two levels. Vectors are dealt to partitions by coarse centroids;
inside, they are held as four-bit codes of a product quantiser with subspaces of
two dimensions. Codebooks and codes minimise the score-aware loss of Guo et al.
(2020): the part of the residual that is parallel to the vector changes large
inner products, so it weighs ``ETA`` times as much as the part across it.

A query scans the code tables of all partitions, whatever their number, as vectors
without clear clusters have neighbours in any of them: a lookup
table holds its inner product with each of the sixteen codewords of a subspace.
The best candidates of each scan, ties included, are scored exactly on the
original vectors in double precision; so is every other row that the scan's
error, as measured on those, may have kept from the answer.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE_ROWS``); every
row is indexed. Queries and rows meet by partition: no side is broadcast and no
partition is gathered whole, as a partition is cut into pieces of at most
``PIECE_ROWS`` rows and the queries go to each piece, in slices of about ``SLICE_ROWS``.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, and neither do those of another dimension than the
sample's most frequent one; ids that are null take no part; rows that repeat an
id each count; ties in score go to the smaller id; fewer candidates than asked
for are all returned; the empty table gives an empty one; columns but the id and the
vector aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import staged

SAMPLE_ROWS = 20_000
#: Rows that a coarse partition has on average. Each query gets answers from each, so that larger ones mean fewer rows to rank.
PARTITION_ROWS = 4_000
PIECE_ROWS, SLICE_ROWS = 8_192, 8_192
SUB, CODES, ETA = 2, 16, 4.0
#: Candidates of each scan that are scored exactly, in multiples of the answers asked for.
RERANK = 5
#: Scan errors, in standard deviations, within which further rows are scored exactly.
ERROR = 2.5


def usable(vector: Column) -> Column:
    """Whether the vector takes part, whatever its length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(axis=1)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (norms - 2 * x[lo : lo + 4096] @ centres.T).argmin(axis=1)
    return out


class Quantiser:
    """Codebooks for the residuals x - centre, and codes under the anisotropic loss."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books  # (k, d) and (subspaces, 16, SUB)

    @staticmethod
    def split(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SUB
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)

    @classmethod
    def fit(cls, x: np.ndarray, partitions: int, rounds: int = 6, seed: int = 4) -> Quantiser:
        x = x.astype(np.float32)
        centres = _kmeans(x, min(partitions, len(x)), 8, seed)
        rest = cls.split(x - centres[_nearest(x, centres)])
        books = np.stack([_kmeans(np.ascontiguousarray(rest[:, m]), min(CODES, len(x)), 6, seed + m) for m in range(rest.shape[1])])
        out = cls(centres, np.pad(books, ((0, 0), (0, CODES - books.shape[1]), (0, 0)), mode="edge"))
        for _ in range(rounds):
            out._refit(x)
        return out

    def _refit(self, x: np.ndarray) -> None:
        """New codewords for the codes of now: weighted least squares, a subspace at a time.

        The weight matrix of a vector is I + (ETA - 1) u u', u its direction; the
        residual outside the subspace enters through its parallel part.
        """
        centre = _nearest(x, self.centres)
        codes = self.encode(x, centre)
        unit = self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        rest = self.split(x - self.centres[centre])
        words = self.books[np.arange(len(self.books)), codes]
        parallel = ((rest - words) * unit).sum(axis=(1, 2))
        for m in range(len(self.books)):
            u = unit[:, m]
            outer = parallel - ((rest[:, m] - words[:, m]) * u).sum(axis=1)
            weight = np.eye(SUB, dtype=np.float32) + (ETA - 1) * u[:, :, None] * u[:, None, :]
            aim = (weight @ rest[:, m, :, None])[:, :, 0] + (ETA - 1) * outer[:, None] * u
            for c in np.unique(codes[:, m]):
                own = codes[:, m] == c
                self.books[m, c] = np.linalg.solve(weight[own].sum(axis=0) + 1e-6 * np.eye(SUB), aim[own].sum(axis=0))
            words[:, m] = self.books[m, codes[:, m]]
            parallel = outer + ((rest[:, m] - words[:, m]) * u).sum(axis=1)

    def encode(self, x: np.ndarray, centre: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        unit = self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        rest = self.split(x - self.centres[centre])
        gap = rest[:, :, None, :] - self.books[None]
        square = (gap**2).sum(axis=3)
        along = (gap * unit[:, :, None, :]).sum(axis=3)
        codes = square.argmin(axis=2)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(len(self.books)), codes].sum(axis=1)
        for _ in range(rounds):
            for m in range(len(self.books)):
                outer = total - along[rows, m, codes[:, m]]
                loss = square[:, m] + (ETA - 1) * (outer[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(axis=1)
                total = outer + along[rows, m, codes[:, m]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, subspaces, 16) inner products with the codewords."""
        return np.einsum("qmd,mcd->qmc", self.split(queries), self.books)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return even[:, 0::2] | (even[:, 1::2] << 4)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products, less the centre's part, of all queries with all coded rows."""
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(tables), -1, 256)  # a byte looks up both its codes
    out = np.zeros((len(tables), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        out += pairs[:, b].astype(np.float32)[:, codes[:, b]]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scored(queries: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen (query, row) pairs and their exact products."""
    i, j = np.nonzero(chosen)
    score = np.empty(len(i))
    for lo in range(0, len(i), 16_384):
        cut = slice(lo, lo + 16_384)
        score[cut] = np.einsum("nd,nd->n", queries[i[cut]], vectors[j[cut]])
    return i, j, score


def _search_piece(model: Quantiser, part: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    out = []
    for lo in range(0, len(queries), 128):
        q, qid = queries[lo : lo + 128], query_ids[lo : lo + 128]
        rough = scan(model.tables(q.astype(np.float32)), codes)
        rough[ids[None, :] == qid[:, None]] = -np.inf
        n = min(RERANK * k, len(ids))
        bar = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
        best = (rough >= bar[:, None]) & np.isfinite(rough)  # ties with the last one come along
        i, j, exact = _scored(q, vectors, best)
        # What the scan may have misjudged: rows within its own error of the k-th exact score.
        # The error is taken from evenly spaced rows, as the best by scan are a biased choice.
        probe = np.linspace(0, len(ids) - 1, min(len(ids), 128)).astype(np.int64)
        off = q @ vectors[probe].T - np.where(np.isfinite(rough[:, probe]), rough[:, probe], np.nan)
        mean, spread = np.nanmean(off, axis=1), np.nanstd(off, axis=1)
        many = np.bincount(i, minlength=len(q))
        kth = np.full(len(q), -np.inf)
        order = np.lexsort((-exact, i))
        first = np.searchsorted(i[order], np.arange(len(q)))
        full = many >= k
        kth[full] = exact[order][(first + k - 1)[full]]
        more = (rough >= (kth - mean - ERROR * spread)[:, None]) & np.isfinite(rough) & ~best
        i2, j2, exact2 = _scored(q, vectors, more)
        i, j, exact = np.concatenate((i, i2)), np.concatenate((j, j2)), np.concatenate((exact, exact2))
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        out.append(pd.DataFrame({"query_id": qid[i[top]], "vec_id": ids[j[top]], "score": exact[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each query, its own id aside.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"  # no digit is lost
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim, count = sizes
    rows = rows.filter(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    held = np.vstack([_matrix(c, dim) for c in sample.column("v").chunks])
    partitions = max(1, min(len(held) // 8, math.ceil(count / PARTITION_ROWS)))
    model = Quantiser.fit(held, partitions)
    shared = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                cut = b.slice(lo, 2048)
                x = _matrix(cut.column(1), dim).astype(np.float32)
                own = _nearest(x, shared.value.centres)
                codes = packed(shared.value.encode(x, own))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "part", "code"])

    indexed = staged(rows.mapInArrow(index, f"vec_id long, v {kind}, part int, code binary"), "index")
    loads = indexed.groupBy("part").count().select("part", F.ceil(F.col("count") / PIECE_ROWS).cast("int").alias("pieces"))  # one row per partition
    queries = rows.filter(is_query)
    slices = max(1, math.ceil(queries.count() / SLICE_ROWS))
    coded = indexed.join(F.broadcast(loads), "part").select("part", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "vec_id", "v", "code")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"))
    asked = asked.crossJoin(F.broadcast(loads)).select(F.col("part").alias("part"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "slice", "query_id", "q")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        own = np.stack(left["v"].to_numpy()).astype(np.float64)
        return _search_piece(shared.value, int(key[0]), left["vec_id"].to_numpy(), codes, own, right["query_id"].to_numpy(), np.stack(right["q"].to_numpy()).astype(np.float64), k)

    found = coded.groupBy("part", "piece", "slice").cogroup(asked.groupBy("part", "piece", "slice")).applyInPandas(meet, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """Brute force, for measuring recall."""
    score = vectors @ query
    order = np.lexsort((ids, -score))
    return [(int(ids[i]), float(score[i])) for i in order if ids[i] != own][:k]
