"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources they belong to). A flow
routes each pattern's words to the quotas of its sources; a pattern's words may be used
several times, each repetition dearer than the one before (convex costs), so repeats come
only where fresh words run out. Each pattern's flow is then turned into whole copies of
its documents and one more copy of those that come first in a seeded order, up to an
exact cut that is found by counting (as in `shards`).

Only patterns, sources and counts are on the driver, PATTERNS of the patterns at most: where
there are more, documents of those with the fewest words count for one of their sources each,
dealt evenly, which leaves every target and every bound as it is.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; documents without words take part with 0; repeated rows have one place in the
order and are taken alike; an empty table gives no rows; a document without any source is
never taken; extra columns are kept, but size and copies take the place of input columns of
these names.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, named, others, packed, unpacked, word_count
from graphloom.llm.shards import Splitter, splitters

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Membership patterns that are kept apart: the bound of all that is collected or broadcast.
PATTERNS = 50_000
SEED = 20240229


def order_of(source: str | None) -> tuple[bool, str]:
    return (source is None, source or "")


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = REPEATS) -> dict[str | None, float]:
    """Each source's target: `share` of all sizes by weight, none above `limit` times its
    source's size; what is above is shared again by weight among the others."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=order_of))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > limit * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(limit * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        open_ -= over
    return out


class Flow:
    """Greatest flow by levels: each phase fills all shortest augmenting paths at once."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def fill(self, source: int, sink: int) -> None:
        while (level := self._levels(source, sink)) is not None:
            at = [0] * len(self.out)  # arcs of a node before this one are spent
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    much = min(self.room[e] for e in path)
                    for k, e in enumerate(path):
                        self.room[e] -= much
                        self.room[e ^ 1] += much
                    full = next(k for k, e in enumerate(path) if not self.room[e])
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.out[x]
                while at[x] < len(arcs) and not (self.room[arcs[at[x]]] and level[self.to[arcs[at[x]]]] == level[x] + 1):
                    at[x] += 1
                if at[x] < len(arcs):
                    path.append(arcs[at[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level if level[sink] >= 0 else None


def routed(capacity: dict[tuple, int], quota: dict[str | None, float], *, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words to take of each pattern: the cheapest flow that fills most of the quotas, where the
    k-th use of a word costs k * k (or any costs that rise with k).

    Costs lie on the arcs into the patterns alone, and an augmenting path never takes flow
    back from these. So the cheapest flow is the greatest one over first uses, enlarged to the
    greatest one over first and second uses, and so on: a few greatest flows."""
    patterns, sources = sorted(capacity, key=lambda p: [order_of(s) for s in p]), sorted(quota, key=order_of)
    at = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    flow = Flow(2 + len(patterns) + len(sources))
    uses = {p: flow.arc(0, 2 + k, 0) for k, p in enumerate(patterns)}
    for k, p in enumerate(patterns):
        for s in p:
            flow.arc(2 + k, at[s], repeats * capacity[p])
    for s in sources:
        flow.arc(at[s], 1, round(quota[s]))
    for _ in range(repeats):
        for p, e in uses.items():
            flow.room[e] += capacity[p]
        flow.fill(0, 1)
    return {p: flow.room[e ^ 1] for p, e in uses.items()}


def mixed(docs: DataFrame, *, sources: Column | None = None, key: str = "doc_id", text: str = "text", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, patterns: int = PATTERNS) -> tuple[DataFrame, dict[str | None, tuple[int, float]]]:
    """docs with `size` and `copies` (how often the mix takes the document), and of each source
    its size and its target. `sources` is an array of the sources of a document, its column
    `source` if not given; a document that is in several counts in each."""
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.array("source") if sources is None else sources))
    rows = docs.select(members.alias("members"), word_count(named(text)).alias("size"), _place(key, seed).alias("i"))
    rows = Saved(spark, "mixing").save(rows)
    sizes = {r.s: r.n for r in rows.select(F.explode("members").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("n")).collect()}
    quota = targets(sizes, weights=weights, share=share, limit=repeats)
    # the largest patterns are kept apart; a document of any other counts for one source
    sums = rows.groupBy("members").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "members")
    apart = [tuple(r.members) for r in sums.limit(patterns).collect()]
    capacity = dict.fromkeys(apart, 0)
    own = _own_pattern(spark, apart)
    for r in _in_pattern(rows, own).groupBy("pattern").agg(F.sum("size").alias("n")).collect():
        capacity[tuple(r.pattern)] = r.n
    taken = routed(capacity, quota, repeats=repeats)

    # one order over all: the pattern's number in the high bits, then the seeded order
    order = sorted(capacity, key=lambda p: [order_of(s) for s in p])
    numbered = spark.createDataFrame([(list(p), k << 43) for k, p in enumerate(order)], "m array<string>, g long")
    placed = _in_pattern(rows, own).join(F.broadcast(numbered), F.col("pattern").eqNullSafe(F.col("m"))).drop("m", "members", "pattern")
    below, goals, whole = 0, [], []
    for p in order:
        full, rest = divmod(taken[p], capacity[p]) if capacity[p] else (0, 0)
        whole.append(full)
        goals.append(below + rest)
        below += capacity[p]
    cuts = splitters(placed, goals, 0.0, 0.0) if order else []
    rule = spark.createDataFrame([(list(p), full, *_bound(cut, k << 43)) for k, (p, full, cut) in enumerate(zip(order, whole, cuts, strict=True))], "m array<string>, full int, below long")
    kept = others(docs, "size", "copies")
    marked = docs.select(packed(kept), members.alias("members"), word_count(named(text)).alias("size"), _place(key, seed).alias("i"))
    marked = _in_pattern(marked, own).join(F.broadcast(rule), F.col("pattern").eqNullSafe(F.col("m")), "left")
    out = marked.select(*unpacked(kept), "size", (F.col("full") + F.when(F.col("i") < F.col("below"), 1).otherwise(0)).alias("copies"))
    return out, {s: (sizes[s], quota[s]) for s in sizes}


def _place(key: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(named(key), F.lit(seed)), 1)


def _own_pattern(spark: SparkSession, apart: list[tuple]) -> DataFrame | None:
    """The patterns that are kept apart, if some have several sources (else a source names
    every pattern)."""
    return spark.createDataFrame([(list(p),) for p in apart], "own array<string>") if any(len(p) > 1 for p in apart) else None


def _in_pattern(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    """rows with `pattern`: members if they are kept apart, else one member alone, by the row's
    place in the seeded order."""
    one = F.slice("members", (F.pmod("i", F.greatest(F.size("members"), F.lit(1))) + 1).cast("int"), F.lit(1))
    if own is None:
        return rows.withColumn("pattern", one)
    met = rows.join(F.broadcast(own), F.col("members").eqNullSafe(F.col("own")), "left")
    return met.withColumn("pattern", F.coalesce("own", one)).drop("own")


def _bound(cut: Splitter, group: int) -> tuple[int]:
    """Rows of the group whose place is below this lie below the cut."""
    if cut.group > group:
        return (2**63 - 1,)
    return (cut.item if cut.group == group else 0,)
