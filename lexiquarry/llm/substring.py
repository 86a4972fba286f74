"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; where it falls below a threshold a
chunk ends. The hash sees 32 bytes only, so an insertion moves the chunks around
it and no others, and a passage that two texts share is cut alike inside both.
Chunks are deduplicated by a 96-bit digest; a run of chunks that occurred before
(in the order of doc_id and place) is cut out if it is long enough.

A digest that one task meets again is marked as repeated on the spot and dealt
out at random, so even a passage in a third of all documents sends each task a
few rows only. Texts are chunked once and each chunk is shuffled once: the chunks of
a digest are ranked by their places where they are sorted, never gathered.

Defined cases: a null text counts as empty and gives an empty text; equal rows get
equal results, as one document; rows that share an id but not the text are told apart
by a hash of the text, which also orders them; ties can't occur, as places differ;
rows without an id are returned whole and their passages don't count; very long texts
are chunked whole; the empty table gives an empty one; columns but the id and the
text aren't read, whatever their names; cuts never split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import small, staged

#: Bytes: the least and the greatest length of a chunk, and the mean gap between hash hits.
LEAST, GREATEST, GAP = 12, 256, 20
#: Bytes of repeated chunks in a row from which they are cut out.
RUN = 100
#: Digests that a task remembers; the memory starts anew when it is full.
KEPT_DIGESTS = 200_000
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(text: bytes, least: int = LEAST, greatest: int = GREATEST, gap: int = GAP) -> list[int]:
    """The ends of the text's chunks."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum over j < 32 of GEAR[data[i - j]] << j
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    inside = np.append((data[1:] & 0xC0) == 0x80, False)  # the next byte carries on a character
    ends, last = [], 0
    for c in (np.flatnonzero((h < np.uint32((1 << 32) // gap)) & ~inside) + 1).tolist():
        if c - last < least:
            continue
        while c - last > greatest:
            at = last + greatest
            while inside[at - 1]:
                at -= 1
            ends.append(at)
            last = at
        if c - last >= least:
            ends.append(c)
            last = c
    while len(text) - last > greatest:
        at = last + greatest
        while inside[at - 1]:
            at -= 1
        ends.append(at)
        last = at
    if last < len(text):
        ends.append(len(text))
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, doc_id, text_id, place) of the chunks of (doc_id, text_id, text).

    place is start * 2^9 + size. A chunk that this task has seen at an earlier place has d2 = -1 and a random d1.
    """
    from xxhash import xxh3_128_intdigest, xxh64_intdigest

    seen: dict[int, tuple[int, int, int]] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            d1, d2, ids, own, places = [], [], [], [], []
            for doc, version, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                at = 0
                for end in cuts(text or b""):
                    digest = xxh3_128_intdigest(text[at:end])
                    first = seen.get(digest)
                    if first is not None and first < (doc, version, at):
                        d1.append(xxh64_intdigest(b"%d %d %d" % (doc, version, at)))
                        d2.append(-1)
                    else:
                        if len(seen) >= KEPT_DIGESTS:
                            seen.clear()
                        seen[digest] = (doc, version, at)
                        d1.append(digest & 0xFFFFFFFFFFFFFFFF)
                        d2.append((digest >> 64) & 0x7FFFFFFF)
                    ids.append(doc)
                    own.append(version)
                    places.append(at << 9 | (end - at))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(d2, pa.int32()), pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(places, pa.int64())], ["d1", "d2", "doc_id", "text_id", "place"])


def _identified(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.hash(body).alias("text_id"), body.alias("text"))


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_id, repeated): for each document the places of chunks that occurred before."""
    inner = _identified(documents, doc_id, text).filter("doc_id is not null")
    chunks = inner.mapInArrow(_chunks, "d1 long, d2 int, doc_id long, text_id int, place long")
    earlier = F.rank().over(Window.partitionBy("d1", "d2").orderBy("doc_id", "text_id", "place")) > 1
    again = chunks.select("doc_id", "text_id", "place", (earlier | (F.col("d2") == -1)).alias("again")).filter("again")
    return again.groupBy("doc_id", "text_id").agg(F.collect_set("place").alias("repeated"))


def spans(repeated: list[int], run: int = RUN) -> list[tuple[int, int]]:
    """The (start, end) of runs of repeated places that are long enough."""
    out: list[list[int]] = []
    for start, size in sorted((place >> 9, place & 511) for place in repeated):
        if out and out[-1][1] == start:
            out[-1][1] = start + size
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out if b - a >= run]


def deduplicate(documents: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_bytes, cut_bytes, spans) per input row; spans are byte ranges of the input text."""
    found = staged(repeats(documents, doc_id, text), "repeats")
    joined = _identified(documents, doc_id, text).join(small(found)[0], ["doc_id", "text_id"], "left").select("doc_id", "text", "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, sizes, gone, where = [], [], [], []
                for body, listed in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    body = body or b""
                    own = spans(listed or [], run)
                    left, at = [], 0
                    for a, b in own:
                        left.append(body[at:a])
                        at = b
                    texts.append((b"".join(left) + body[at:]).decode("utf-8", "replace"))
                    sizes.append(len(body))
                    gone.append(sum(b - a for a, b in own))
                    where.append([{"start": a, "end": b} for a, b in own])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, kind)], ["doc_id", "text", "n_bytes", "cut_bytes", "spans"])

    return joined.mapInArrow(cut, "doc_id long, text string, n_bytes long, cut_bytes long, spans array<struct<start:int,end:int>>")
