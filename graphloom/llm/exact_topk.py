"""Exact top-k inner products by aggregation of sorted lists without random access.

Every dimension has a list of a block's candidates in order of their component, sorted once.
A query reads the lists sequentially and all to the same depth: from the greatest component
down where its own component is positive, from the least up where it is negative. What is
read of a candidate is added up. Its upper bound adds, for every list it has not been met
in, the value that the list has been read down to; its lower bound adds that list's worst
value. Reading stops when no more candidates can still be among the k best than there are
places left in a list, so that resolving their scores costs less than reading on.

Queries and candidates meet in blocks of candidates: a block is shuffled once (or to a few
tasks if blocks are fewer than cores), every query is sent to every block, and a task streams
the queries past the block's lists. Only the k best of a block go on, and a window over a
query's best of all blocks gives the result.

Defined cases: vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths have no inner product and never meet, so empty ones meet only
each other, with score 0; ties go to the smaller id; rows equal in id and vector count once,
other rows of one id are candidates each, and of a query's the smallest vector asks; a query
never meets its own id, null ids take no part; fewer candidates than k give all of them;
an empty table has no rows; extra columns are ignored. Scores are below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Saved

BLOCK_ROWS = 8_192  # candidates of a block at most, about
LEAST_ROWS = 2_048
#: Components of a block at most, whatever the vectors' length: a task holds some twenty
#: arrays of this many (see `Lists.step`).
BLOCK_ENTRIES = 8_192 * 64
TILE = 64  # queries that read the lists side by side
#: Shares of the lists after which the bounds are tested.
DEPTHS = (0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, null if one is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale)))


class Lists:
    """The sorted lists of a block: order[c] has the candidates by component c, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.most = float(np.abs(vectors).max(initial=0))
        self.order = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.entries_read = 0
        self._steps: dict[tuple, tuple[np.ndarray, ...]] = {}

    def step(self, before: int, depth: int, kind: type) -> tuple[np.ndarray, ...]:
        """The entries between two depths as candidates x lists: components read from the top
        and from the bottom (0 where nothing is read), and which candidates have been met in
        which lists since the beginning."""
        if (before, depth, kind) not in self._steps:
            n, columns = len(self.ids), np.arange(len(self.order))[:, None]
            out = [np.zeros(self.vectors.shape, dtype=kind) for _ in range(4)]
            for read, met, new, all_ in ((out[0], out[2], slice(n - depth, n - before), slice(n - depth, n)), (out[1], out[3], slice(before, depth), slice(0, depth))):
                read[self.order[:, new], columns] = self.sorted[:, new]
                met[self.order[:, all_], columns] = 1
            self._steps[before, depth, kind] = tuple(out)
        return self._steps[before, depth, kind]

    def best(self, query: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, candidate id, score) of each query's k best, ties to the smaller id."""
        found = [self._tile(query[a : a + TILE], query_ids[a : a + TILE], k, a) for a in range(0, len(query), TILE)]
        parts = [p for some in found for p in some]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _tile(self, query: np.ndarray, query_ids: np.ndarray, k: int, first: int) -> list[tuple[np.ndarray, ...]]:
        n, dims = self.vectors.shape
        k = min(k, n)
        most = self.most * float(np.abs(query).max(initial=0)) * dims
        # whole numbers below 2^24 are exact in single precision; beyond 2^53 bounds get slack
        kind, slack = np.float32 if most < 1 << 24 else np.float64, 0.0 if most < 1 << 53 else most * 1e-12
        active = np.arange(len(query))
        up, down = np.maximum(query, 0).T.astype(kind), np.minimum(query, 0).T.astype(kind)
        partial = np.zeros((n, len(query)), dtype=kind)
        out, before = [], 0
        for depth in sorted({max(1, min(n, int(n * share))) for share in DEPTHS} | {n}):
            read_top, read_low, top, low = self.step(before, depth, kind)
            partial = partial + read_top @ up + read_low @ down
            self.entries_read += (depth - before) * int(np.count_nonzero(up) + np.count_nonzero(down))
            before = depth
            if depth == n:
                upper, lower = partial + slack, partial - slack
            else:

                def rest(at_top: np.ndarray, at_low: np.ndarray, top: np.ndarray = top, low: np.ndarray = low) -> np.ndarray:
                    a, b = up * at_top.astype(kind)[:, None], down * at_low.astype(kind)[:, None]
                    return (a.sum(axis=0) + b.sum(axis=0)) - (top @ a + low @ b)

                upper = partial + rest(self.sorted[:, n - depth], self.sorted[:, depth - 1]) + slack
                lower = partial + rest(self.sorted[:, 0], self.sorted[:, -1]) - slack
            own = query_ids[active]
            for j, (a, b) in enumerate(zip(np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right"), strict=True)):
                upper[a:b, j] = lower[a:b, j] = -np.inf
            gate = np.partition(lower, n - k, axis=0)[n - k]
            left = (upper >= gate) & (upper > -np.inf)
            done = (left.sum(axis=0) <= n - depth) | (depth == n)
            for j in np.flatnonzero(done):
                who = np.flatnonzero(left[:, j])
                score = self.vectors[who] @ query[active[j]]
                best = np.lexsort((who, -score))[:k]
                out.append((np.full(len(best), first + active[j]), self.ids[who[best]], score[best]))
            if done.all():
                break
            active, up, down, partial = active[~done], up[:, ~done], down[:, ~done], partial[:, ~done]
        return out


def _stream(k: int):
    """Rows (place, asks, id, v) in order of place, candidates before queries, to each query's
    best in the place's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, lists = None, [], None
        for batch in batches:
            places, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "asks", "id"))
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(lengths)))
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if a == b:
                    continue
                if places[a] != place:
                    place, held, lists = places[a], [], None
                vectors = values[edges[a] : edges[b]].reshape(b - a, -1) if edges[b] > edges[a] else np.zeros((b - a, 0), np.int64)
                if not asks[a]:
                    held.append((ids[a:b], vectors))
                    continue
                if lists is None and held:
                    lists = Lists(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if lists is not None:
                    of, who, score = lists.best(vectors, ids[a:b], k)
                    yield pa.RecordBatch.from_pydict({"query_id": ids[a:b][of].astype(np.int64), "other": who.astype(np.int64), "score": score.astype(np.int64)})

    return run


def top(vectors: DataFrame, is_query: Column, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), the other vector's id (named `key`), score: of every query the
    k greatest inner products of whole(vector)s, all rows but its own being candidates."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), is_query.alias("asks")).where("v is not null")
    rows = Saved(spark, "topk").save(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")))
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block_rows = max(1, min(block_rows, BLOCK_ENTRIES // max(1, longest or 0)))
    cores = spark.sparkContext.defaultParallelism
    size = min(block_rows, max(min(LEAST_ROWS, block_rows), -(-n // (2 * cores))))
    blocks = max(1, -(-n // size))
    parts = max(1, -(-cores // blocks))
    # a place is a vector length, a block of candidates and a part of the queries
    place = F.xxhash64(F.size("v"), "block", "part")
    candidates = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), "id", "v")
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id", F.lit(6)), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), "id", "v")
    met = candidates.union(queries).select(place.alias("place"), "asks", "id", "v").repartition(blocks * parts, "place").sortWithinPartitions("place", "asks")
    found = met.mapInArrow(_stream(k), "query_id long, other long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("other").alias(key), "score")
