"""Postings counted within each document, in Arrow batches: no posting is shuffled.

Rows are (doc_id, t) with t an array of terms. A batch is worked off in slices of whole
rows of some ``SLICE`` terms, so memory is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions.stemmer import stem

SLICE = 1 << 19
#: Words whose stems a task remembers.
REMEMBERED = 1 << 19


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins, and the last ends; arrays without lists may lack even the first."""
    return lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        yield start, min(end, n)
        start = end


def _tally(ids: pa.Array, owner: np.ndarray, terms: pa.Array, at: np.ndarray | None = None, named: Callable | None = None) -> list[pa.Array]:
    """term, doc_id and tf of each different pair of a term and the row that owns it, and its ``at`` if given; ``named`` maps the different terms."""
    coded = terms.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if named is not None:
        again = named(words).dictionary_encode()
        words, codes = again.dictionary, again.indices.to_numpy().astype(np.int64)[codes]
    pairs = owner * max(len(words), 1) + codes
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    ends = np.append(first, len(pairs))
    rows, own = np.divmod(pairs[first], max(len(words), 1))
    out = [words.take(pa.array(own)), ids.take(pa.array(rows)), pa.array(np.diff(ends).astype(np.int64))]
    if at is not None:
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32))))
    return out


def _stems() -> Callable[[pa.Array], pa.Array]:
    known: dict[str, str] = {}

    def named(words: pa.Array) -> pa.Array:
        if len(known) > REMEMBERED:
            known.clear()
        return pa.array([known.get(w) or known.setdefault(w, stem(w)) for w in words.to_pylist()], pa.string())

    return named


def _schema(rows: DataFrame, positions: bool) -> T.StructType:
    found = T.StructType().add("term", "string").add("doc_id", rows.schema["doc_id"].dataType).add("tf", "long")
    return found.add("positions", T.ArrayType(T.IntegerType())) if positions else found


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "positions"][: len(columns)])


def repeated(rows: DataFrame) -> bool:
    """Whether rows share a doc_id."""
    return not rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _once(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that share an id are one document: where there are any, their postings are put together."""
    if not repeated(rows):
        return found
    more = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if "positions" in found.columns else []
    return found.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), *more)


def per_document(rows: DataFrame, stops=(), stems: bool = False, positions: bool = False) -> DataFrame:
    """(term, doc_id, tf), with ``positions`` the places from 1 of a term in t as well; stop words are left out, then terms stemmed."""
    unwanted = list(stops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = _stems() if stems else None
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = _offsets(lists)
            for start, end in _slices(offsets):
                terms = lists.values.slice(offsets[start], offsets[end] - offsets[start])
                owner = np.repeat(np.arange(start, end), np.diff(offsets[start : end + 1]))
                at = np.arange(offsets[start], offsets[end]) - offsets[owner] + 1 if positions else None
                if unwanted:
                    kept = pc.invert(pc.is_in(terms, value_set=pa.array(unwanted, pa.string())))
                    mask = kept.to_numpy(zero_copy_only=False)
                    terms, owner, at = terms.filter(kept), owner[mask], at[mask] if positions else None
                yield _batch(_tally(ids, owner, terms, at, named))

    whole = rows.select("doc_id", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    return _once(whole.mapInArrow(run, _schema(rows, positions)), rows)


def _joined(words: pa.Array, *at: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(i)) for i in at), " ")


def phrases(rows: DataFrame, unfit: tuple[str, ...], crossing: bool = True) -> DataFrame:
    """(term, doc_id, tf) of the two- and three-word phrases in (doc_id, t), t the tokens of each line that has any.

    A phrase starts three tokens before its line's end at least, or joins the last words of a line to
    the first of the next (only with ``crossing``); words of ``unfit`` don't stand in a phrase. Lines of
    rows that share an id have no order among each other: no phrase joins them.
    """

    def found(words: pa.Array, lines: np.ndarray, docs: np.ndarray) -> tuple[list[pa.Array], list[np.ndarray]]:
        """Of the tokens, the lines' and the documents' offsets: phrases and the token that each begins or ends with."""
        ok = pc.invert(pc.is_in(words, value_set=pa.array(unfit, pa.string()))).to_numpy(zero_copy_only=False)
        n = len(ok)
        place = np.arange(n)
        within = place <= np.repeat(lines[1:], np.diff(lines)) - 3
        after = np.append(ok[1:], [False, False])
        pair = within & ok & after[:n]
        twos = np.flatnonzero(pair)
        threes = np.flatnonzero(pair & after[1 : n + 1])
        texts, at = [_joined(words, twos, twos + 1), _joined(words, threes, threes + 1, threes + 2)], [twos, threes]
        if crossing:
            starts = np.setdiff1d(lines[1:-1], docs)  # lines after the first of their document
            sizes = dict(zip(lines[:-1].tolist(), np.diff(lines).tolist()))
            before = lines[np.searchsorted(lines, starts) - 1]
            starts, before = starts[m := ok[starts] & ok[starts - 1]], before[m]
            two = (starts - before > 1) & ok[starts - 2]
            after_one = np.array([sizes[s] > 1 for s in starts.tolist()], bool)
            three = after_one & ok[np.minimum(starts + 1, n - 1)]
            a, b, c = starts[two], starts[~two], starts[three]
            texts += [_joined(words, a - 2, a - 1, a), _joined(words, b - 1, b), _joined(words, c - 1, c, c + 1)]
            at += [a, b, c]
        return texts, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            line_at, token_at = _offsets(lists), _offsets(lists.values)
            offsets = token_at[line_at]
            for start, end in _slices(offsets):
                words = lists.values.values.slice(offsets[start], offsets[end] - offsets[start])
                docs = offsets[start : end + 1] - offsets[start]
                texts, at = found(words, token_at[line_at[start] : line_at[end] + 1] - offsets[start], docs)
                owner = np.searchsorted(docs, np.concatenate(at), side="right") - 1 + start
                yield _batch(_tally(ids, owner, pa.concat_arrays(texts)))

    whole = rows.select("doc_id", F.coalesce("t", F.array().cast("array<array<string>>")).alias("t"))
    return _once(whole.mapInArrow(run, _schema(rows, False)), rows)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all slices, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def phrase_lists(rows: DataFrame, keys: list[tuple[str, list[str]]]) -> DataFrame:
    """(key, doc_id, positions) of (doc_id, t): rows that hold every term of a key, with their places from 1 in the order of the terms.

    ``rows`` has each doc_id once. A key is looked up by the term that the fewest rows of a slice hold, so that frequent terms
    don't meet every key they are in.
    """
    names = pa.array([k for k, _ in keys], pa.string())
    asked = pa.array([t for _, terms in keys for t in terms], pa.string()).dictionary_encode()
    needs = np.array([len(terms) for _, terms in keys], np.int64)
    begins = np.cumsum(needs) - needs
    codes = asked.indices.to_numpy().astype(np.int64)
    known = len(asked.dictionary)

    def found(ids: pa.Array, owner: np.ndarray, terms: pa.Array, at: np.ndarray) -> pa.RecordBatch:
        own = pc.index_in(terms, value_set=asked.dictionary)
        mask = own.is_valid().to_numpy(zero_copy_only=False)
        pairs = owner[mask] * known + own.drop_null().to_numpy().astype(np.int64)
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[mask][order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        sizes, held = np.diff(np.append(first, len(pairs))), pairs[first]
        docs, words = np.divmod(held, known)
        df = np.bincount(words, minlength=known)
        # Each key under its rarest term here; a term's keys lie together.
        place = np.repeat(np.arange(len(needs)), needs)
        rank = np.lexsort((codes, df[codes], place))
        rarest = codes[rank[begins]]
        by_term = np.argsort(rarest, kind="stable")
        many = np.bincount(rarest, minlength=known)
        starts = np.cumsum(many) - many
        doc = np.repeat(docs, many[words])
        key = by_term[_ragged(starts[words], many[words])]
        # All terms of the candidates, as groups of ``held``.
        each = needs[key]
        term = codes[_ragged(begins[key], each)]
        wanted = np.repeat(doc, each) * known + term
        group = np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))
        there = held[group] == wanted if len(held) else np.zeros(0, bool)
        which = np.repeat(np.arange(len(key)), each)
        whole = np.bincount(which[there], minlength=len(key)) == each
        group, doc, key, each = group[whole[which]], doc[whole], key[whole], each[whole]
        inner = np.concatenate(([0], np.cumsum(sizes[group]))).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(inner), pa.array(at[_ragged(first[group], sizes[group])].astype(np.int32)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), places)
        return pa.RecordBatch.from_arrays([names.take(pa.array(key)), ids.take(pa.array(doc)), lists], names=["key", "doc_id", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = _offsets(lists)
            for start, end in _slices(offsets):
                terms = lists.values.slice(offsets[start], offsets[end] - offsets[start])
                owner = np.repeat(np.arange(start, end), np.diff(offsets[start : end + 1]))
                yield found(ids, owner, terms, np.arange(offsets[start], offsets[end]) - offsets[owner] + 1)

    schema = T.StructType().add("key", "string").add("doc_id", rows.schema["doc_id"].dataType).add("positions", T.ArrayType(T.ArrayType(T.IntegerType())))
    whole = rows.select("doc_id", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    return whole.mapInArrow(run, schema)
