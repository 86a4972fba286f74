"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed terms of three kinds: words, word shapes (letter case,
digits, trailing signs) and traits of the whole text (how often words and lines
repeat). Term counts are damped, weighted by inverse document frequency and
projected by a truncated singular value decomposition. The projected labelled
sample is broadcast: its size is bounded by ``rows`` x ``rank`` numbers. Every
document is then compared with all of it, in blocks of exact cosine products,
and the nearest vote with their similarity as weight.

Defined cases: a null, empty or wordless text has no vector and gets the
sample's share of label 1; rows of labels whose label or id is null, or that
name no document, are ignored; a repeated label counts once, the larger value
winning; of differing texts that share an id one is learned from; without labelled rows
every score is 0.5; ties among neighbours go to any of equal similarity, which changes no
score but by rounding unless more tie than vote; whole texts are read, however long;
repeated rows each get the same score; the empty table gives an empty one; ``keep``
carries other columns on, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.toxicity import labelled_sample, remainder

#: Labelled documents in the space at most, its rank, and the voters.
SAMPLE_ROWS, RANK, VOTERS = 5_000, 48, 15
#: Hashed places for words, shapes and traits.
WORDS, SHAPES, TRAITS = 2048, 1024, 64
PLACES = WORDS + SHAPES + TRAITS
#: The share of a vector's length that each kind gets.
SHARES = ((0, WORDS, 0.5), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, PLACES, 1.0))
#: Documents compared at once.
BLOCK = 512
KEPT_WORDS = 300_000

_CLASSES = bytes.maketrans(bytes(range(256)), bytes(ord("0") if chr(c).isdigit() else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256)))


def _squeezed(shape: bytes) -> bytes:
    out = bytearray()
    for c in shape:
        if not out or out[-1] != c or c not in b"aA0":
            out.append(c)
    return bytes(out[:12])


class Terms:
    """(places, counts) of a text's terms."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def _word(self, raw: bytes) -> tuple[int, int]:
        from xxhash import xxh32_intdigest

        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        found = self.known[raw] = (xxh32_intdigest(raw.lower(), 1) % WORDS, WORDS + xxh32_intdigest(_squeezed(raw.translate(_CLASSES)), 2) % SHAPES)
        return found

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
        words = (text or b"").split()
        if not words:
            return None
        counts = Counter(words)
        known = self.known
        places = np.array([known.get(w) or self._word(w) for w in counts], dtype=np.int64)
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        dense = np.bincount(places.ravel(), np.repeat(times, 2), PLACES)
        n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
        same = sum(a == b for a, b in zip(words, words[1:])) / n
        traits = (min(15, int(16 * same)), 16 + min(15, int(16 * len(counts) / n)), 32 + min(15, int(16 * len(set(lines)) / len(lines))), 48 + min(15, int(np.log2(n))))
        dense[[WORDS + SHAPES + t for t in traits]] = 1
        at = np.flatnonzero(dense)
        return at, np.log1p(dense[at])


def weighted(terms: list[tuple[np.ndarray, np.ndarray] | None], idf: np.ndarray) -> np.ndarray:
    """Dense rows: each kind of term scaled to its share of the length."""
    out = np.zeros((len(terms), PLACES), np.float32)
    for row, found in zip(out, terms):
        if found is not None:
            row[found[0]] = found[1] * idf[found[0]]
    for lo, hi, share in SHARES:
        part = out[:, lo:hi]
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part *= np.divide(share, norm, out=np.zeros_like(norm), where=norm > 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(terms: list, labels: np.ndarray, rank: int = RANK, seed: int = 9) -> dict:
    """The space and the labelled vectors in it."""
    df = np.zeros(PLACES)
    for found in terms:
        if found is not None:
            df[found[0]] += 1
    idf = np.log((1 + len(terms)) / (1 + df)) + 1
    x = weighted(terms, idf)
    rank = min(rank, *x.shape)
    start = np.random.default_rng(seed).standard_normal((PLACES, min(rank + 12, PLACES))).astype(np.float32)
    y = x @ start
    for _ in range(3):  # power iterations of the randomised decomposition
        y, _ = np.linalg.qr(y)
        y = x @ (x.T @ y)
    y, _ = np.linalg.qr(y)
    _, _, basis = np.linalg.svd(y.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(basis[:rank].T.astype(np.float32))
    return {"idf": idf, "basis": basis, "vectors": _unit(x @ basis), "labels": labels.astype(np.float64), "prior": float(labels.mean())}


def vote(model: dict, terms: list, voters: int = VOTERS) -> np.ndarray:
    """Scores by the nearest labelled vectors, weighted by their cosine."""
    vectors, labels = model["vectors"], model["labels"]
    k = min(voters, len(labels))
    out = np.full(len(terms), model["prior"])
    for lo in range(0, len(terms), BLOCK):
        part = terms[lo : lo + BLOCK]
        cos = _unit(weighted(part, model["idf"]) @ model["basis"]) @ vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        some = total > 0
        out[lo : lo + len(part)][some] = (weight * labels[near]).sum(axis=1)[some] / total[some]
    return out


def train(sample: DataFrame) -> dict | None:
    """Term counts are made in parallel, the space is fitted in one task on the bounded sample; the driver gets the model alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Terms()
        for b in batches:
            found = [make(x.as_py()) or (np.zeros(0, np.int64), np.zeros(0)) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))], ["doc_id", "label", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (np.array(x.values) for x in b.column(2)), (np.array(x.values) for x in b.column(3))) if len(row[2])]
        if not held:
            return
        held.sort(key=lambda row: row[0])
        model = fit([(p.astype(np.int64), c.astype(np.float64)) for _, _, p, c in held], np.array([y for _, y, _, _ in held]))
        parts = {k: np.atleast_1d(np.asarray(v)) for k, v in model.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts)), pa.array([list(v.shape) for v in parts.values()], pa.list_(pa.int64())), pa.array([v.astype(np.float64).tobytes() for v in parts.values()], pa.binary())], ["name", "shape", "data"])

    terms = sample.select("doc_id", "text", "label").mapInArrow(count, "doc_id long, label int, places array<int>, counts array<float>")
    got = terms.repartition(1).mapInArrow(run, "name string, shape array<long>, data binary").toArrow().to_pylist()
    model = {r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in got}
    if not model:
        return None
    return {"idf": model["idf"], "basis": model["basis"].astype(np.float32), "vectors": model["vectors"].astype(np.float32), "labels": model["labels"], "prior": float(model["prior"][0])}


def score(documents: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, threshold: float = 0.3, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    ids = F.col(doc_id).cast("long")
    scored = with_score(documents, labels, label, mod, held, rows, doc_id, text, [ids.alias("doc_id")])
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int, doc_id: str, text: str, columns: list) -> DataFrame:
    """The given columns of ``documents`` and ``score``."""
    from pyspark.sql import types as T

    model = train(labelled_sample(documents, labels, label, rows, remainder(F.col("doc_id"), mod) != held, doc_id, text))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    inner = documents.select(F.struct(*columns).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Terms()
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                if shared.value is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    scores = vote(shared.value, [make(x.as_py()) for x in part.column(1).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["row", "score"])

    schema = T.StructType([inner.schema["row"], T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).select("row.*", "score")


def keep(documents: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, threshold: float = 0.3, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that aren't rejected, with the columns of ``documents``."""
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)]
    scored = with_score(documents, labels, label, mod, held, rows, doc_id, text, names)
    return scored.filter(F.col("score") >= threshold).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)))
