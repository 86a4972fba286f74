"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
Two link when they differ in at most ``budget`` bits. The join walks pairs of
trie nodes together, adds up the bits in which their branches differ, and drops
a pair once the budget is spent.

To deal the walk out, the 64 bits are split into budget + 1 blocks (more for
very many fingerprints) and one trie is built for each choice of blocks to come
first. Two fingerprints within the budget agree wholly in the leading blocks of
one trie at least, so each trie is cut below those blocks and every subtree is
walked on its own. A subtree with too many fingerprints is cut again into
smaller node pairs, each with its share of the budget already spent.

Only distinct fingerprints are joined, and a task returns a spanning forest of
what it linked, not all pairs: node pairs that already lie in one group are
skipped, which keeps large groups of near copies cheap.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; one with fewer words than a shingle
is one shingle; repeated rows each get a result; rows whose id is null take the
group's id, or null if no row of the group has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import staged
from lexiquarry.llm.graph import connected_components

SEED = 42
#: Fingerprints in a subtree from which it is cut into node pairs.
SUBTREE_ROWS = 20_000
#: Node pairs walked at once in a task, and rows that one task walks.
FRONTIER = 1 << 18
TASK_ROWS = 150_000
#: A node pair with so few leaf pairs is compared leaf by leaf.
LEAF_PAIRS = 32


def vote(hashes: list[int]) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    whole = np.array(hashes, dtype=np.uint64)
    for part in range(0, len(whole), 1 << 16):
        bits = np.unpackbits(whole[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * counts > len(whole), bitorder="little")
    return int(chosen.view(np.int64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The text's fingerprint as a signed long."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # for bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return vote([xxh64_intdigest(b" ".join(words), SEED)])
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return vote([xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def tries(count: int, budget: int = 3) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie: the bit ranges (start, length) in their order, and the depth of the cut."""
    blocks = budget + 1 + (count > 1 << 22) + (count > 1 << 30)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    orders = []
    for first in combinations(range(blocks), blocks - budget):
        order = [spans[i] for i in first] + [spans[i] for i in range(blocks) if i not in first]
        orders.append((order, sum(n for _, n in order[: len(first)])))
    return orders


def permuted(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The unsigned fingerprints with their bit ranges in the given order, from the top."""
    out = np.zeros_like(fp)
    at = 64
    for start, n in order:
        at -= n
        out |= ((fp >> np.uint64(64 - start - n)) & np.uint64((1 << n) - 1)) << np.uint64(at)
    return out


class Groups:
    """Labels of rows, and which runs of rows share one label."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)
        self._runs()

    def _runs(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
        self._runs()

    def united(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        c = self.changes
        return (c[hi1 - 1] == c[lo1]) & (c[hi2 - 1] == c[lo2]) & (self.label[lo1] == self.label[lo2])


def _splits(values: np.ndarray, depth: int, cache: dict[int, np.ndarray]) -> np.ndarray:
    if depth not in cache:
        zero = ((values >> np.uint64(63 - depth)) & np.uint64(1)) == 0
        cache[depth] = np.concatenate(([0], np.cumsum(zero))).astype(np.int64)
    return cache[depth]


def walk(values: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, budget: int) -> np.ndarray:
    """Labels of the rows of ``values`` after linking all pairs within the budget.

    ``nodes``: the pairs to start from, as (lo1, hi1, lo2, hi2, spent) ranges of
    rows that are sorted and agree, within each range, in their first ``depth`` bits.
    """
    groups, cache, stack = Groups(len(values)), {}, [(depth, nodes)]
    while stack:
        depth, (lo1, hi1, lo2, hi2, spent) = stack.pop()
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            stack += [(depth, tuple(x[half:] for x in (lo1, hi1, lo2, hi2, spent))), (depth, tuple(x[:half] for x in (lo1, hi1, lo2, hi2, spent)))]
            continue
        own = lo1 == lo2
        keep = (spent <= budget) & (hi1 > lo1) & (hi2 > lo2) & ~(own & (hi1 - lo1 < 2))
        lo1, hi1, lo2, hi2, spent = (x[keep] for x in (lo1, hi1, lo2, hi2, spent))
        keep = ~groups.united(lo1, hi1, lo2, hi2)
        lo1, hi1, lo2, hi2, spent = (x[keep] for x in (lo1, hi1, lo2, hi2, spent))
        if not len(lo1):
            continue
        product = (hi1 - lo1) * (hi2 - lo2)
        leaf = (product <= LEAF_PAIRS) | (depth >= 64)
        if leaf.any():
            n = product[leaf]
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (hi2 - lo2)[leaf][which]
            i, j = lo1[leaf][which] + step // wide, lo2[leaf][which] + step % wide
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                groups.join(i[near], j[near])
        rest = ~leaf
        if not rest.any():
            continue
        lo1, hi1, lo2, hi2, spent = (x[rest] for x in (lo1, hi1, lo2, hi2, spent))
        zeros = _splits(values, depth, cache)
        mid1, mid2 = lo1 + zeros[hi1] - zeros[lo1], lo2 + zeros[hi2] - zeros[lo2]
        other = lo1 != lo2
        parts = [(lo1, mid1, mid2, hi2, spent + 1), (mid1[other], hi1[other], lo2[other], mid2[other], spent[other] + 1), (mid1, hi1, mid2, hi2, spent), (lo1, mid1, lo2, mid2, spent)]
        stack.append((depth + 1, tuple(np.concatenate(x) for x in zip(*parts))))
    return groups.label


def _subtrees(batches: Iterator[pa.RecordBatch], orders: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for trie, (order, depth) in enumerate(orders):
            turned = permuted(fp, order)
            node = (turned >> np.uint64(64 - depth)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), trie, np.int32)), pa.array(node), pa.array(turned.view(np.int64)), batch.column(0)], ["trie", "node", "turned", "fp"])


def _forest(fp: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    linked = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(keys)) if len(keys) else first


def _walk_whole(batches: Iterator[pa.RecordBatch], depths: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """Every subtree that fell into this task, each against itself."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    trie, turned, fp = (whole.column(c).to_numpy() for c in ("trie", "turned", "fp"))
    turned = turned.view(np.uint64)
    for t in np.unique(trie):
        mine = np.flatnonzero(trie == t)
        mine = mine[np.argsort(turned[mine], kind="stable")]
        values = turned[mine]
        lo, hi = _ranges(values >> np.uint64(64 - depths[t]))
        yield _forest(fp[mine], walk(values, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)), depths[t], budget))


def _walk_pairs(batches: Iterator[pa.RecordBatch], depths: list[int], bits: int, budget: int) -> Iterator[pa.RecordBatch]:
    """The node pairs of cut subtrees that fell into this task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    trie, node, x, y, sub, turned, fp = (whole.column(c).to_numpy() for c in ("trie", "node", "x", "y", "sub", "turned", "fp"))
    for t in np.unique(trie):
        mine = np.flatnonzero(trie == t)
        mine = mine[np.lexsort((turned[mine].view(np.uint64), sub[mine], y[mine], x[mine], node[mine]))]
        values = turned[mine].view(np.uint64)
        pair = np.stack([node[mine], x[mine], y[mine]])
        lo, hi = _ranges(np.cumsum(np.concatenate(([0], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))))
        right = sub[mine] != x[mine]
        ones = np.concatenate(([0], np.cumsum(right)))
        mid = hi - (ones[hi] - ones[lo])
        same = x[mine][lo] == y[mine][lo]
        spent = np.bitwise_count((x[mine][lo] ^ y[mine][lo]).view(np.uint64)).astype(np.int64)
        nodes = (lo, np.where(same, hi, mid), np.where(same, lo, mid), hi, spent)
        yield _forest(fp[mine], walk(values, nodes, depths[t] + bits, budget))


def links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints ``fp`` whose components are those of all links."""
    count = prints.count()
    orders = tries(count, budget)
    depths = [depth for _, depth in orders]
    spread = prints.select("fp").mapInArrow(lambda it: _subtrees(it, orders), "trie int, node long, turned long, fp long")
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * len(orders) / TASK_ROWS))
    sizes = staged(spread.groupBy("trie", "node").count().filter(F.col("count") > SUBTREE_ROWS), "subtrees")
    largest = sizes.agg(F.max("count")).first()[0]
    if largest is None:
        return spread.repartition(parts, "trie", "node").mapInArrow(lambda it: _walk_whole(it, depths, budget), "a long, b long")
    hot = sizes.select("trie", "node")
    usual = spread.join(hot, ["trie", "node"], "left_anti").repartition(parts, "trie", "node").mapInArrow(lambda it: _walk_whole(it, depths, budget), "a long, b long")
    bits = min(16, max(2, math.ceil(math.log2(largest / SUBTREE_ROWS)) + 3))
    cut = F.lit(64 - bits) - F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("trie") + 1)
    spread_hot = spread.join(hot, ["trie", "node"], "left_semi").withColumn("sub", F.call_function("shiftright", F.col("turned"), cut).bitwiseAND(F.lit((1 << bits) - 1)))
    subs = staged(spread_hot.select("trie", "node", "sub").distinct(), "nodes")
    pairs = subs.withColumnRenamed("sub", "x").join(subs.withColumnRenamed("sub", "y"), ["trie", "node"]).filter((F.col("x") <= F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget))
    ends = pairs.select("trie", "node", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("sub"))
    dealt = spread_hot.join(ends, ["trie", "node", "sub"]).select("trie", "node", "x", "y", "sub", "turned", "fp")
    cold = dealt.repartition(4 * parts, "trie", "node", "x", "y").mapInArrow(lambda it: _walk_pairs(it, depths, bits, budget), "a long, b long")
    return usual.unionByName(cold)


def components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per input row."""
    docs = staged(fingerprints(documents, doc_id, text, width), "fingerprints")
    prints = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(links(prints, budget))
    grouped = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """The input rows whose id is their group's smallest, all columns kept.

    Of rows that share that id one stays; rows without an id stay.
    """
    groups = components(documents, doc_id, text, width, budget)
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = staged(kept, "kept")
    single = documents.join(kept.filter("copies = 1").select(F.col("doc_id").alias(doc_id)), doc_id, "left_semi")
    several = kept.filter("copies > 1").select(F.col("doc_id").alias(doc_id))
    if not several.isEmpty():
        single = single.unionByName(documents.join(several, doc_id, "left_semi").dropDuplicates([doc_id]))
    return single.unionByName(documents.filter(F.col(doc_id).isNull()))
