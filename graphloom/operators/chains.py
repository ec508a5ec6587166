"""Chains and cycles of edges in time: each edge is followed by the earliest one that begins
where it ends.

Edges have id, src, dst, start and end (numbers, such as `intervals.micros` gives). An edge's
successor starts at its dst, not before its end; with a tolerance, no later than that after
it. Of several the earliest start follows, of equal starts the smallest id. The successor is
found as-of, in bins of a node's time, so a node with many edges is dealt to many tasks: the
first edge behind a time is in its bin, or the first one of the next bin that has any. Edges
without a start follow nothing, and an edge without an end (still open) has no successor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.intervals import _bin
from graphloom.operators.loops import Saved, components

DAY = 86_400_000_000


def successors(edges: DataFrame, *, tolerance: int | None = None, width: int = DAY, itself: bool = False) -> DataFrame:
    """(id, next, next_dst, gap): the edge that follows each edge that has one, and the time
    between. itself: an edge may follow itself (a loop at a node, without duration)."""
    saved = Saved(edges.sparkSession, "successors")
    rights = edges.where("start is not null").select(F.col("src").alias("node"), F.col("start").alias("t"), "id", "dst")
    lefts = edges.where("end is not null").select(F.col("dst").alias("node"), F.col("end").alias("t"), "id")
    binned = lambda rows: rows.withColumn("bin", _bin(F.col("t"), F.lit(width)))
    order = Window.partitionBy("node", "bin").orderBy("t", "id")
    # of two candidates one is not the edge itself
    this = F.struct("t", "id", "dst")
    # what comes first behind a row is what came last in falling order, which Spark need not look for again
    rights = saved.save(binned(rights).select("node", "bin", "t", "id", F.array_compact(F.array(this, F.lead(this).over(order))).alias("two"), F.row_number().over(order).alias("place")))
    kind = rights.schema["two"].dataType
    lefts = binned(lefts).select("node", "bin", "t", "id")
    inside = lefts.select("*", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("two")).union(rights.select("node", "bin", "t", "id", F.lit(1), "two"))
    behind = Window.partitionBy("node", "bin").orderBy(F.desc("t"), F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    here = inside.withColumn("found", F.last("two", ignorenulls=True).over(behind)).where("side = 0").select("node", "bin", "t", "id", "found")
    # the first edges of the next bin that has any: a row for each bin of a node
    firsts = rights.where("place = 1").select("node", "bin", "two")
    bins = lefts.select("node", "bin", F.lit(True).alias("asked")).distinct().join(firsts, ["node", "bin"], "full_outer")
    later = Window.partitionBy("node").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = saved.save(bins.select("node", "bin", "asked", F.last("two", ignorenulls=True).over(later).alias("later")).where("asked").drop("asked"))
    both = F.concat(F.coalesce("found", F.array().cast(kind)), F.coalesce("later", F.array().cast(kind)))
    fits = lambda x: F.lit(itself) | (x["id"] != F.col("id"))
    out = here.join(ahead, ["node", "bin"]).select("id", "t", F.get(F.filter(both, fits), 0).alias("x")).where("x is not null")
    out = out.select("id", F.col("x.id").alias("next"), F.col("x.dst").alias("next_dst"), (F.col("x.t") - F.col("t")).alias("gap"))
    return out if tolerance is None else out.where(F.col("gap") <= tolerance)


def _without_loops(edges: DataFrame, steps: DataFrame, saved: Saved) -> DataFrame:
    """Steps without those that close a loop. All edges of a loop lie at one instant, so only
    steps between edges without duration are looked at, of which there are few or none. The step
    back to a loop's smallest edge goes."""
    flat = edges.where(F.col("start") == F.col("end"))
    now = saved.save(steps.where("gap = 0").join(flat.select("id"), "id", "left_semi").join(flat.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next"))
    links, left = now, now.count()
    most, reach = left, 1
    while left and reach <= most:  # pointers of `reach` steps; those that are left in the end are on loops
        jump = now.select(F.col("id").alias("next"), F.col("next").alias("to"))
        now = saved.save(now.join(jump, "next").select("id", F.col("to").alias("next")))
        left, reach = now.count(), 2 * reach
    if not left:
        return steps
    on = saved.save(now.select(F.col("next").alias("id")).distinct())
    loops = links.join(on, "id", "left_semi").select(F.col("id").alias("a"), F.col("next").alias("b"))
    least = components(loops).select(F.col("component").alias("next")).distinct()
    closing = loops.join(least, F.col("b") == F.col("next")).select(F.col("a").alias("id"))
    return saved.save(steps.join(closing, "id", "left_anti"))


def chains(edges: DataFrame, *, tolerance: int = 0, width: int = DAY) -> DataFrame:
    """(id, nodes, last): the chain that begins with each edge that has a successor: its nodes
    in order, and its last edge. A chain ends before it would come back to an edge.

    Pointer doubling: after k rounds a row holds the nodes of the next 2^k edges and the edge
    behind them, so a chain of n edges takes log2(n) joins."""
    saved = Saved(edges.sparkSession, "chains")
    edges = saved.save(edges.select("id", "src", "dst", "start", "end"))  # several steps read them
    steps = saved.save(successors(edges, tolerance=tolerance, width=width))
    steps = _without_loops(edges, steps, saved)
    # path: nodes reached from the edge's dst on; at: the edge that the path ends with
    now = open_ = saved.save(steps.select("id", F.array("next_dst").alias("path"), F.col("next").alias("at")))
    done: DataFrame | None = None
    while not open_.isEmpty():
        jump = now.select(F.col("id").alias("at"), F.col("path").alias("more"), F.col("at").alias("to"))
        ended = F.col("to").isNull()
        grown = saved.save(open_.join(jump, "at", "left").select("id", F.when(ended, F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.coalesce("to", "at").alias("at"), ended.alias("ended")))
        finished, open_ = (grown.where(c).select("id", "path", "at") for c in ("ended", "NOT ended"))
        done = finished if done is None else done.union(finished)
        now = done.union(open_)
    ends = edges.select("id", F.array("src", "dst").alias("first"))
    return now.join(ends, "id").select("id", F.concat("first", "path").alias("nodes"), F.col("at").alias("last"))


def patterns(chains: DataFrame, *, min_frequency: int = 1) -> DataFrame:
    """signature (nodes joined by >), frequency: of the rows' nodes."""
    return chains.groupBy(F.array_join("nodes", ">").alias("signature")).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)


def time_cycles(edges: DataFrame, *, longest: int = 6, width: int = DAY) -> DataFrame:
    """(id, nodes): from each edge the way along successors back to its own src, of `longest`
    edges at most. A way that comes to another node twice is given up."""
    saved, kept = Saved(edges.sparkSession, "cycles"), Saved(edges.sparkSession, "closed")
    edges = saved.save(edges.select("id", "src", "dst", "start", "end"))  # several steps read them
    steps = saved.save(successors(edges, width=width, itself=True)).select(F.col("id").alias("at"), "next", "next_dst")
    now = edges.select("id", F.col("id").alias("at"), F.array("src", "dst").alias("nodes"))
    home: Column = F.element_at("nodes", -1) == F.element_at("nodes", 1)
    for k in range(longest):
        kept.save(now.where(home).select("id", "nodes"))
        if k < longest - 1:
            fresh = ~F.array_contains(F.expr("slice(nodes, 2, greatest(size(nodes) - 2, 0))"), F.col("next_dst")) | (F.col("next_dst") == F.element_at("nodes", 1))
            first = saved.count
            now = saved.save(now.where(~home).join(steps, "at").where(fresh).select("id", F.col("next").alias("at"), F.concat("nodes", F.array("next_dst")).alias("nodes")))
            if k:  # the edges (0) and steps (1) stay
                saved.drop(first - 1, first)
    saved.drop_all()
    return kept.all()
