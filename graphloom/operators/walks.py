"""Seeded walks: the next node is the neighbour whose digest with the start and the step is least.

Every neighbour of a walk's place is hashed, so the work is the sum of the degrees that the walks
stand at, and at a node that is linked to a share of all it grows with the square of the graph. What
a task holds is bounded: links are dealt once to blocks, a node with many neighbours to cells of
some of its neighbours and some of its walks, and a step sends the walks alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.digests import least_md5
from graphloom.operators.graph import adjacency
from graphloom.operators.loops import Saved

LINKS = 1_000_000  # links of a block, about
LEAST = 32  # blocks, at least
PART = 65_536  # neighbours of a cell, about

_MOVED = pa.schema([("start", pa.string()), ("path", pa.string()), ("digest", pa.string()), ("dst", pa.string())])


def _packed(links: pa.Table) -> pa.Table:
    """A block's links in the order of their cells, as one row."""
    cell = links["cell"].combine_chunks().dictionary_encode()
    order = np.argsort(cell.indices.to_numpy(), kind="stable")
    rows = pa.table({"cell": cell.take(pa.array(order)), "dst": links["dst"].combine_chunks().take(pa.array(order))})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return pa.table({"block": links["block"].slice(0, 1), "links": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _stepped(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def step(packed: pa.Table, walks: pa.Table) -> pa.Table:
        if not walks.num_rows:
            return _MOVED.empty_table()
        links = pa.ipc.open_stream(packed["links"][0].as_buffer()).read_all().combine_chunks()
        cell, dst = links["cell"].combine_chunks(), links["dst"].combine_chunks()
        bounds = np.searchsorted(cell.indices.to_numpy(), np.arange(len(cell.dictionary) + 1))
        at = pc.index_in(walks["cell"].combine_chunks(), value_set=cell.dictionary)
        walks, at = walks.filter(at.is_valid()), at.drop_null().to_numpy()  # a part may have no neighbour
        if not walks.num_rows:
            return _MOVED.empty_table()
        start = walks["start"].combine_chunks()
        digest, chosen = least_md5(pc.binary_join_element_wise(start, f"|{k}|", ""), bounds[at], bounds[at + 1], dst)
        return pa.Table.from_arrays([start, walks["path"].combine_chunks(), pa.array(digest, pa.string()), dst.take(pa.array(chosen))], schema=_MOVED)

    return step


def hashed_walks(edges: DataFrame, steps: int) -> DataFrame:
    """(start, path): a walk over the undirected neighbours from each node; step k goes to the
    neighbour with the least md5 of start|k|neighbour. path: the nodes, with > between them."""
    saved = Saved(edges.sparkSession, "hashed")
    links = saved.save(adjacency(edges))
    degree = saved.save(links.groupBy("src").agg(F.count("*").alias("n")))
    hubs = saved.save(degree.where(F.col("n") > PART).select("src", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    # a hub's links go to each slice of its walks
    total = degree.join(hubs, "src", "left").agg(F.sum(F.col("n") * F.coalesce("parts", F.lit(1)))).first()[0] or 0
    blocks = max(LEAST, -(-total // LINKS))
    shared = not hubs.isEmpty()

    def dealt(rows: DataFrame, node: str, *keep: str, whole: str, one: str) -> DataFrame:
        """Rows to their cells: the hash of column `one` tells one number of a hub's cell, and the
        row goes to every other number, `whole`."""
        parts = F.coalesce("parts", F.lit(1))
        rows = rows.join(hubs.withColumnRenamed("src", node), node, "left") if shared else rows.withColumn("parts", F.lit(1))
        rows = rows.withColumn("own", F.pmod(F.xxhash64(one), parts)).withColumn("every", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.withColumnsRenamed({"own": "part" if whole == "slice" else "slice", "every": whole})
        cell = F.concat_ws(".", "part", "slice", node)
        return rows.select(F.pmod(F.xxhash64(cell), F.lit(blocks)).cast("int").alias("block"), cell.alias("cell"), *keep)

    cells = dealt(links, "src", "dst", whole="slice", one="dst")
    packed = saved.save(cells.groupBy("block").applyInArrow(_packed, "block int, links binary"))
    packed = packed.repartition(blocks, "block").persist()
    now = degree.select(F.col("src").alias("start"), F.col("src").alias("node"), F.col("src").alias("path"))
    try:
        for k in range(1, steps + 1):
            sent = dealt(now, "node", "start", "path", whole="part", one="start")
            moved = packed.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_stepped(k), "start string, path string, digest string, dst string")
            if shared:
                moved = moved.groupBy("start", "path").agg(F.min_by("dst", "digest").alias("dst"))
            now = saved.save(moved.select("start", F.col("dst").alias("node"), F.concat("path", F.lit(">"), "dst").alias("path")))
    finally:
        packed.unpersist()
    return now.select("start", "path")
