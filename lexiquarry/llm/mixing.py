"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern, and only the patterns' sizes go on: a flow network routes the patterns'
capacity to the sources' quotas. A pattern can be used up to ``repeats`` times;
each further use of the same tokens costs more than the last (a convex cost),
so the cheapest flow repeats as little as it can. As the cost depends on the
pattern's use alone, the successive cheapest augmentation is a maximum flow with
every pattern's first use open, carried on with the second use opened, and so
forth.

The flow gives each pattern its number of tokens. Whole uses go to every
document; the rest goes to a seeded random choice of documents, found by
narrowing a hash threshold level by level, so no source's documents are ever
sorted in one place. What the threshold leaves over is filled with the largest
documents that still fit.

Defined cases: a null or wordless text has size zero and is taken zero times;
null is a source of its own, last in order, and that of an array that is null or empty;
a source of size zero has target zero; very long texts count whole; ties go by hash;
other columns are carried on by ``select``, whatever their names; repeated rows are told apart by a seeded rank among themselves only as far
as their hash goes, and rows that agree in everything are taken together or left
together; the empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import SPACE, pieces, staged

#: Patterns that the driver routes at most; a table with more raises an error.
MAX_PATTERNS = 100_000
#: Hash bits per narrowing level, and the number of levels.
LEVEL_BITS, LEVELS = 10, 3
#: Documents that fill what the threshold leaves over.
FILLS = 4


def word_count(text: Column) -> Column:
    return F.size(pieces(text, SPACE)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above cap times its size.

    What a capped source can't take is shared again among the others by weight.
    """
    left, heavy, out = share * sum(sizes), float(sum(weights)), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        out[i] = min(float(cap * sizes[i]), left * weights[i] / heavy)
        left, heavy = left - out[i], heavy - weights[i]
    return out


class Flow:
    """A maximum flow that can go on after capacity is added (Dinic)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.arcs: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                x = queue.popleft()
                for e in self.arcs[x]:
                    if self.room[e] > 0 and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if t not in level:
                return
            at = dict.fromkeys(self.arcs, 0)
            while self._push(s, t, level, at):
                pass

    def _push(self, s: int, t: int, level: dict, at: dict) -> int:
        path, x = [], s
        while x != t:
            while at[x] < len(self.arcs[x]):
                e = self.arcs[x][at[x]]
                if self.room[e] > 0 and level.get(self.to[e]) == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(self.arcs[x]):
                path.append(e)
                x = self.to[e]
            elif path:
                e = path.pop()
                x = self.to[e ^ 1]
                at[x] += 1
            else:
                return 0
        most = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= most
            self.room[e ^ 1] += most
        return most


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = 2) -> list[int]:
    """Tokens that each (member sources, size) pattern gives, by cheapest flow."""
    flow, s, t = Flow(), 0, 1
    first = 2 + len(patterns)
    gate = [flow.arc(s, 2 + p, 0) for p in range(len(patterns))]
    for p, (members, size) in enumerate(patterns):
        for m in members:
            flow.arc(2 + p, first + m, repeats * size)
    for m, quota in enumerate(quotas):
        flow.arc(first + m, t, quota)
    for _ in range(repeats):  # each use costs more than the one before: open them in turn
        for g, (_, size) in zip(gate, patterns):
            flow.room[g] += size
        flow.run(s, t)
    return [flow.room[g ^ 1] for g in gate]


def _draw(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """(pattern, left, cut): of each pattern's documents in hash order, as many as fit in ``need``.

    ``rows``: (pattern, size, hash); ``needs``: (pattern, need). Returns one row
    per pattern: documents with hash below ``cut`` are drawn, and ``left`` is
    what their sizes leave of the need.
    """
    within, open_ = rows, needs.select("pattern", F.col("need").alias("left"), F.lit(0).cast("long").alias("prefix"))
    shift = 63
    for _ in range(LEVELS):
        shift -= LEVEL_BITS
        step = F.shiftright(F.col("hash"), shift)
        inside = within.join(F.broadcast(open_), "pattern").filter(F.shiftright(F.col("hash"), shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("pattern", step.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(_order("bucket"))
        over = sums.withColumn("sum", running).join(F.broadcast(open_), "pattern")
        fit = over.filter(F.col("sum") <= F.col("left")).groupBy("pattern").agg(F.max("sum").alias("used"))
        edge = over.filter(F.col("sum") > F.col("left")).groupBy("pattern").agg(F.min("bucket").alias("bucket"))
        open_ = staged(open_.join(fit, "pattern", "left").join(edge, "pattern", "left").select("pattern", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("bucket", F.lit(-1).cast("long")).alias("prefix")), "draw")
    inside = within.join(F.broadcast(open_), "pattern").filter(F.shiftright(F.col("hash"), shift) == F.col("prefix"))
    same = inside.groupBy("pattern", "hash").agg(F.sum("size").alias("size"))
    over = same.withColumn("sum", F.sum("size").over(_order("hash"))).join(F.broadcast(open_), "pattern")
    fit = over.filter(F.col("sum") <= F.col("left")).groupBy("pattern").agg(F.max("sum").alias("used"))
    edge = over.filter(F.col("sum") > F.col("left")).groupBy("pattern").agg(F.min("hash").alias("cut"))
    return open_.join(fit, "pattern", "left").join(edge, "pattern", "left").select("pattern", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))


def _order(column: str):
    from pyspark.sql import Window

    return Window.partitionBy("pattern").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)


def _fill(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """(pattern, hash): single documents, each the largest that still fits what is left."""
    left, chosen = drawn, None
    for _ in range(FILLS):
        rest = rows.join(F.broadcast(left), "pattern").filter((F.col("hash") >= F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
        if chosen is not None:
            rest = rest.join(F.broadcast(chosen), ["pattern", "hash"], "left_anti")
        one = staged(rest.groupBy("pattern").agg(F.max(F.struct("size", "hash")).alias("m")).select("pattern", "m.size", "m.hash"), "fill")
        same = rows.join(F.broadcast(one.select("pattern", "hash")), ["pattern", "hash"]).groupBy("pattern", "hash").agg(F.sum("size").alias("size"))
        whole = same.join(F.broadcast(left), "pattern").filter(F.col("size") <= F.col("left"))  # equal rows go together
        left = staged(left.join(whole.select("pattern", "size"), "pattern", "left").select("pattern", (F.col("left") - F.coalesce("size", F.lit(0))).alias("left"), "cut"), "left")
        took = whole.select("pattern", "hash")
        chosen = staged(took if chosen is None else chosen.unionByName(took), "chosen")
    return chosen


def _decorated(documents: DataFrame, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """(row, pattern, size, hash): ``documents`` as structs of columns c0, c1, ..., so that no name clashes."""
    own = F.col(f"`{source}`")
    nothing = F.array(F.lit(None).cast("string"))
    several = dict(documents.dtypes)[source].startswith("array")
    member = F.when(F.size(own) > 0, own.cast("array<string>")).otherwise(nothing) if several else F.array(own.cast("string"))
    salt = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), salt, body).bitwiseAND(F.lit((1 << 63) - 1))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)), F.col(f"`{doc_id}`").cast("long").alias("id"))
    return documents.select(row.alias("row"), F.to_json(F.array_sort(F.array_distinct(member))).alias("pattern"), word_count(body).alias("size"), hashed.alias("hash"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """(row, size, copies, source_size, target) per input row; row holds id, and with ``carry`` all columns as c0, c1, ...

    ``source`` is a string column, or an array of strings where a document
    belongs to several sources: ``source_size`` and ``target`` are then sums over
    its sources. Weights go round the sources in code-point order, null last.
    """
    marked = _decorated(documents, seed, doc_id, text, source)
    rows = staged(marked.select(F.struct("row.id").alias("row"), "pattern", "size", "hash"), "sizes")
    spark = documents.sparkSession
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size")).withColumn("members", F.from_json("pattern", "array<string>"))
    known = totals.limit(MAX_PATTERNS + 1).collect()
    if len(known) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group sources before mixing them")
    known.sort(key=lambda r: r["pattern"])
    names = sorted({m for r in known for m in r["members"]}, key=lambda m: (m is None, (m or "").encode("utf-8")))
    place = {m: i for i, m in enumerate(names)}
    members = [tuple(place[m] for m in r["members"]) for r in known]
    sizes = [sum(r["size"] for r, own in zip(known, members) if i in own) for i in range(len(names))]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    given = route([(m, r["size"]) for m, r in zip(members, known)], [round(g) for g in goal], cap)
    plan = [(r["pattern"], g // r["size"] if r["size"] else 0, g % r["size"] if r["size"] else 0, sum(sizes[i] for i in m), float(sum(goal[i] for i in m))) for r, m, g in zip(known, members, given)]
    planned = spark.createDataFrame(plan, "pattern string, whole long, need long, source_size long, target double")
    drawn = staged(_draw(rows, planned.select("pattern", "need")), "drawn")
    chosen = _fill(rows, drawn)
    base = marked if carry else rows
    full = base.join(F.broadcast(planned), "pattern").join(F.broadcast(drawn.select("pattern", "cut")), "pattern").join(F.broadcast(chosen.withColumn("extra", F.lit(1))), ["pattern", "hash"], "left")
    more = (F.col("hash") < F.col("cut")) | F.col("extra").isNotNull()
    return full.select("row", "size", (F.col("whole") + more.cast("long")).alias("copies"), "source_size", "target")


def taken(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per input row."""
    return mix(documents, **options).select(F.col("row.id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def select(documents: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their columns and ``copies``, how often; ``copies`` replaces a column of that name."""
    mixed = mix(documents, carry=True, **options).filter((F.col("copies") > 0) & (F.col("size") > 0))
    return mixed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns) if c != "copies"), "copies")
