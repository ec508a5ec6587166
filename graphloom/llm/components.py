"""Linking through shared buckets without listing all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Saved
from graphloom.operators.loops import components

Verify = Callable[[DataFrame], DataFrame]


def crowded(visits: DataFrame) -> DataFrame:
    """The visits (anchor, node) to anchors that more than one node visits, each once. The
    anchors are found by a partial aggregate, and a frequent one is split in the join."""
    several = visits.groupBy("anchor").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("anchor")
    return visits.join(several, "anchor", "left_semi").distinct()


def linked(shared: DataFrame, near: Callable[[str, str], Column], verify: Verify | None = None, *, facts: DataFrame | None = None, picks: int = 6, star_rounds: int = 2) -> DataFrame:
    """(node, component) of all nodes with a link; nodes that share an anchor are compared.

    shared: anchor, node (long), as `crowded` gives them and saved; near(x, y) compares two
    rows of facts (node and what else it needs; the node alone if not given); verify takes
    pairs (a, b) and returns those that are links. Three passes, of which each leaves less:

    1. every node picks the anchors with the least hashes, and is held against one leader of
       each: nodes with much in common pick the same, at a cost of `picks` pairs a node;
    2. in anchors that still hold several components, every node against a few leaders;
    3. what is left, all pairs of an anchor that are near and in different components.

    No link that changes a component is lost, and a dense group never emits its pairs."""
    saved = Saved(shared.sparkSession, "anchors")
    held = None if facts is None else facts.select("node", F.struct(*facts.columns).alias("f"))

    def links_of(pairs: DataFrame) -> DataFrame:
        return saved.save((verify(pairs) if verify else pairs).select("a", "b"))

    # 1
    least = shared.groupBy("node").agg(*[F.min_by("anchor", F.xxhash64("anchor", F.lit(k))).alias(f"k{k}") for k in range(picks)])
    picked = saved.save(least.select("node", F.explode(F.array_distinct(F.array(*[f"k{k}" for k in range(picks)]))).alias("anchor")))
    lead = picked.groupBy("anchor").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").select("anchor", "b")
    pairs = picked.join(lead, "anchor").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    if held is None:
        close = pairs.select("a", "b", F.struct(F.col("a").alias("node")).alias("x"), F.struct(F.col("b").alias("node")).alias("y"))
    else:
        close = pairs.join(held.select(F.col("node").alias("a"), F.col("f").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("f").alias("y")), "b")
    close = close.where(near("x", "y")).groupBy("a").agg(F.min("b").alias("b"))
    groups = saved.save(components(links_of(close)))

    # 2
    label = saved.save(_mixed(shared, groups))
    rows = label if facts is None else label.join(facts, "node")
    payload = [c for c in rows.columns if c != "anchor"]
    stars = None
    for k in range(star_rounds):
        lead = rows.groupBy("anchor").agg(F.min_by(F.struct(*payload), F.xxhash64("node", F.lit(k))).alias("l")).select("anchor", "l.*")
        met = rows.alias("x").join(lead.alias("y"), (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.component") != F.col("y.component"))).where(near("x", "y"))
        by = F.struct(F.xxhash64("y.node", F.lit(k)), F.col("y.node").alias("b"))
        # of the leaders that a node is near to, two tie the anchors together that it visits
        found = met.groupBy(F.col("x.node").alias("a")).agg(F.min(by).alias("s"), F.max(by).alias("t"))
        found = saved.save(found.select("a", F.explode(F.array("s.b", "t.b")).alias("b")).distinct())
        stars = found if stars is None else stars.union(found)
    known = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = saved.save(components(known.union(links_of(stars.distinct()))))

    # 3
    label = saved.save(_mixed(label.select("anchor", "node"), groups))
    rows = label if facts is None else saved.save(label.join(facts, "node"))
    x, y = rows.alias("x"), rows.alias("y")
    rest = x.join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & near("x", "y"))
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    known = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(links_of(rest)))


def _mixed(visits: DataFrame, groups: DataFrame) -> DataFrame:
    """anchor, node, component: the visits to anchors that more than one component visits."""
    label = visits.join(groups, "node", "left").select("anchor", "node", F.coalesce("component", "node").alias("component"))
    several = label.groupBy("anchor").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("anchor")
    return label.join(several, "anchor", "left_semi")
