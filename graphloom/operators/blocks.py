"""Rounds over the neighbours of all nodes, block by block.

Nodes are numbered in their order, and a block holds every so-manyth of them with all of their
links, as arrays. In a round a block gets from each block one packed row, the values of just
those nodes that it has links to; the links themselves are dealt out once and stay there. So a
round shuffles a number for each node and block that needs it, not a row for each link."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved

LINKS = 2_000_000  # links of a block, about: a task has some 200 bytes for each
LEAST = 16  # blocks, at least

#: own values, links' row starts, values of the links' far ends, round -> new own values
Step = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_FIXED = "block int, peer int, a binary, b binary"
_SENT = "block int, peer int, v binary, squares double"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _packed(n_blocks: int) -> Callable[[pa.Table], pa.Table]:
    """A block's links (s, t) as row starts and places in what it is sent, and for each block the
    places that it has to send from."""

    def pack(links: pa.Table) -> pa.Table:
        block = links["block"][0].as_py()
        t = links["t"].to_numpy()
        wide = np.int64(t.max() // n_blocks + 1)
        need, place = np.unique((t % n_blocks) * wide + t // n_blocks, return_inverse=True)
        del t
        pair = np.unique(links["s"].to_numpy() // n_blocks * np.int64(len(need)) + place)  # repeated links count once
        s, place = pair // len(need), (pair % len(need)).astype(np.int32)
        del pair
        start = np.searchsorted(s, np.arange(s[-1] + 2))
        rows = [(block, -1, start.astype(np.int64).tobytes(), place.tobytes())]
        for peer in np.unique(need // wide):
            rows.append((int(peer), block, (need[need // wide == peer] % wide).astype(np.int32).tobytes(), b""))
        return _table(rows, ["block", "peer", "a", "b"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return pack


class Blocks:
    """nodes (node, id) and n; links of the undirected graph of edges (src, dst) without self-loops."""

    def __init__(self, edges: DataFrame, name: str) -> None:
        from graphloom.operators.graph import numbered

        self.saved = Saved(edges.sparkSession, name)
        edges = self.saved.save(edges.where("src <> dst").select("src", "dst"))
        self.nodes, self.n = numbered(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node")
        blocks = max(LEAST, -(-2 * edges.count() // LINKS))
        ids = edges.join(self.nodes.select(F.col("node").alias("src"), F.col("id").alias("x")), "src").join(self.nodes.select(F.col("node").alias("dst"), F.col("id").alias("y")), "dst")
        ends = F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("t")), F.struct(F.col("y").alias("s"), F.col("x").alias("t")))
        links = ids.select(F.explode(ends).alias("e")).select((F.col("e.s") % blocks).cast("int").alias("block"), "e.s", "e.t")
        packed = self.saved.save(links.groupBy("block").applyInArrow(_packed(blocks), _FIXED))
        self.blocks = blocks
        self.fixed = packed.repartition(blocks, "block").persist()
        self.fixed.count()  # its partitions are known where it is joined

    def run(self, step: Step, first: float | None, rounds: int, *, kind: type = np.float64, share: bool = False, norm: bool = False, every: int = 5) -> DataFrame:
        """(node, value) after the rounds. first: every node's value, its number if None. share: a
        node sends its value divided by its degree. norm: the values have the L2 norm 1 at
        the end, and every few rounds, so that they stay small."""
        blocks = self.blocks

        def play(scale: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
            def one(fixed: pa.Table, sent: pa.Table) -> pa.Table:
                peers = fixed["peer"].to_pylist()
                block, at = fixed["block"][0].as_py(), peers.index(-1)
                start = _array(fixed["a"][at], np.int64)
                if scale is None:
                    n = len(start) - 1
                    own = np.full(n, first, kind) if first is not None else np.arange(n, dtype=kind) * blocks + block
                else:
                    got = dict(zip(sent["peer"].to_pylist(), sent["v"], strict=True))
                    own = _array(got.pop(-1), kind)
                    far = np.concatenate([_array(got[p], kind) for p in sorted(got)])
                    if scale != 1.0:
                        own, far = own * scale, far * scale
                    own = step(own, start, far[_array(fixed["b"][at], np.int32)])
                out = own / np.diff(start) if share else own
                rows = [(block, -1, own.tobytes(), float(np.dot(own, own)) if norm else 0.0)]
                rows += [(peer, block, out[_array(places, np.int32)].tobytes(), 0.0) for peer, places in zip(peers, fixed["a"], strict=True) if peer >= 0]
                return _table(rows, ["block", "peer", "v", "squares"], [pa.int32(), pa.int32(), pa.binary(), pa.float64()])

            return one

        fixed = self.fixed
        sent = fixed.limit(0).select("block", "peer", F.col("a").alias("v"), F.lit(0.0).alias("squares"))
        scale: float | None = None
        try:
            for k in range(rounds + 1):
                sent = fixed.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(play(scale), _SENT)
                scale = 1.0
                if k and (k % every == 0 or k == rounds):  # the plan stays short
                    sent = self.saved.save(sent)
                    if norm:
                        scale = 1.0 / float(np.sqrt(sent.where("peer = -1").agg(F.sum("squares")).first()[0] or 1.0))
        finally:
            fixed.unpersist()
        last = scale if norm else 1.0

        def own(batches):
            for batch in batches:
                for block, v in zip(batch["block"].to_pylist(), batch["v"], strict=True):
                    values = _array(v, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int64) * blocks + block), pa.array(values * last if norm else values)], names=["id", "value"])

        value = "double" if kind is np.float64 else "long"
        rows = sent.where("peer = -1").select("block", "v").mapInArrow(own, f"id long, value {value}")
        return rows.join(self.nodes, "id").select("node", "value")


def summed(far: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each row; every node has a neighbour."""
    return np.add.reduceat(far, start[:-1])


def most_frequent(far: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each row's labels, the smallest of equals."""
    row = np.repeat(np.arange(len(start) - 1, dtype=np.int32), np.diff(start))
    far = far[np.lexsort((far, row))]  # rows are in their order
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (far[1:] != far[:-1])])
    row, far, n = row[new], far[new], np.diff(np.r_[new, len(row)])
    best = np.lexsort((far, -n, row))
    return far[best][np.flatnonzero(np.r_[True, row[best][1:] != row[best][:-1]])]
