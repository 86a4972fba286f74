"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are word unigrams (also cut to their first letters, which stands for a
stem), bigrams and skip-grams, hashed into 2^bits places. Training follows
McMahan et al. (2013): each coordinate has its own rate, and the L1 term leaves
most weights at zero, so the model is a short list of places and weights whose
size is bounded by 2^bits.

Training reads a bounded sample of the labelled rows, in one task; scoring reads
every whole text, in a single narrow pass.

Defined cases: a null, empty or wordless text has only the bias; rows of labels
whose label or id is null, or that name no document, are ignored; a repeated
label counts once, the larger value winning; of differing texts that share an id one is
learned from; without labelled rows every score is 0.5; whole texts are read, however
long; repeated rows each get the same score; the empty table gives an empty one; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import staged

BITS = 20
#: Labelled documents that the model is fitted on at most.
TRAIN_ROWS = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
STEMS = (4, 6)
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"
#: Distinct words whose hashes a task keeps; the table starts anew when it is full.
KEPT_WORDS = 400_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class Features:
    """Hashed features of a text: sorted distinct places."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def _word(self, raw: bytes) -> tuple[int, ...]:
        from xxhash import xxh64_intdigest

        word = raw.strip(EDGES)
        letters = word.decode("utf-8", "replace")
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        found = self.known[raw] = (xxh64_intdigest(word, 1), *(xxh64_intdigest(letters[:n].encode(), n) for n in STEMS))
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        pairs = np.array([known.get(w) or self._word(w) for w in words], dtype=np.uint64)
        word = pairs[:, 0]
        grams = [_mix(pairs.ravel(), 3), _mix(word[:-1] * np.uint64(31) + word[1:], 7), _mix(word[:-2] * np.uint64(37) + word[2:], 11)]
        return np.unique((np.concatenate(grams) >> np.uint64(64 - self.bits)).astype(np.int64))


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the non-zero coordinates."""
    make, size = Features(bits), 1 << bits
    rows = [make(t).astype(np.int32) for t in texts]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], size)
            w = weights(i)
            w[-1] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA + L2)  # the bias has no L1 term
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    every[size] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA + L2)
    places = np.flatnonzero(every[:size])
    return places, every[places], float(every[size])


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, eligible: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents, by hash order of their ids; of texts that share an id the one of least hash."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(eligible).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    chosen = staged(chosen, "chosen-labels")  # at most ``rows`` rows: small enough to broadcast
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    return sample.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit in one task on (doc_id, text, label); only the weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((d, x or "", y) for b in batches for d, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label"))))
        if not got:
            return
        places, weights, bias = fit([x for _, x, _ in got], np.array([float(y) for _, _, y in got]), bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(weights, bias))], ["place", "weight"])

    table = sample.repartition(1).mapInArrow(run, "place long, weight double").toArrow()
    places, weights = table.column("place").to_numpy(), table.column("weight").to_numpy()
    own = places < 0
    return places[~own], weights[~own], float(weights[own].sum())


def scorer(model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> Callable[[list], np.ndarray]:
    places, weights, bias = model
    dense = np.zeros(1 << bits, np.float32)
    dense[places] = weights
    make = Features(bits)

    def score(texts: list) -> np.ndarray:
        total = np.array([dense[make(t)].sum(dtype=np.float64) for t in texts]) if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))

    return score


def score(documents: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held: int = 1, threshold: float = 0.7, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    model = train(labelled_sample(documents, labels, label, rows, remainder(F.col("doc_id"), mod) != held, doc_id, text))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()))], ["doc_id", "score"])

    scored = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
