"""Average-linkage clusters over a sparse table of similarities.

A pair that is not in the table has similarity 0. Two clusters are as similar as their pairs
are on average; the most similar two are joined as long as that reaches the threshold. The
order does not matter but for exact ties: an average never exceeds the larger of the two that
it comes from, so clusters that are each other's nearest stay so whatever else is joined,
and all such pairs are joined at once in each round (reciprocal nearest neighbours). A pair
of clusters holds the sum of its similarities, so a round's update is one sum over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved, components


def _within(pairs: DataFrame, threshold: float, saved: Saved) -> DataFrame:
    """Pairs whose ends could ever meet: an average reaches the threshold only if a pair does,
    so clusters lie within the components of such pairs. What crosses them goes."""
    strong = pairs.where(F.col("score") >= threshold)
    part = saved.save(components(strong.select("a", "b")))
    x, y = part.select(F.col("node").alias("a"), F.col("component").alias("pa")), part.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    return pairs.join(x, "a").join(y, "b").where("pa = pb").drop("pa", "pb")


def average_linkage(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster): nodes of pairs (a, b, score; each pair once, scores above 0) that share a
    cluster with another node; the cluster's name is its smallest node. The threshold is above
    0. Of exactly equal similarities the pair with the smaller names comes first within a round."""
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: all pairs that are not in the table have 0")
    saved, merges = Saved(pairs.sparkSession, "linkage"), Saved(pairs.sparkSession, "merges")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").cast("double").alias("total"), F.col("score")).where("a <> b AND score > 0")
    links = saved.save(_within(pairs, threshold, saved).select("a", "b", "total"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = saved.save(ends.select("node", F.lit(1).alias("size")))
    while True:
        x, y = sizes.select(F.col("node").alias("a"), F.col("size").alias("na")), sizes.select(F.col("node").alias("b"), F.col("size").alias("nb"))
        mean = (F.col("total") / (F.col("na") * F.col("nb"))).alias("mean")
        near = links.join(x, "a").join(y, "b").select("a", "b", mean).where(F.col("mean") >= threshold)
        # one order of all pairs, for both ends: the first of them all is always mutual
        order = F.struct(-F.col("mean"), "a", "b")
        both = near.select(F.explode(F.array("a", "b")).alias("node"), order.alias("o"))
        first = both.groupBy("node").agg(F.min("o").alias("o")).groupBy("o.a", "o.b").agg(F.count("*").alias("n")).where("n = 2")
        joined, (n, _) = merges.signed(first.select(F.col("b").alias("node"), F.col("a").alias("into")), "node")
        if not n:
            break
        renamed = lambda rows, c: rows.join(joined.withColumnsRenamed({"node": c, "into": "_into"}), c, "left").withColumn(c, F.coalesce("_into", c)).drop("_into")
        moved = renamed(renamed(links, "a"), "b").where("a <> b")
        links = saved.save(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")))
        sizes = saved.save(renamed(sizes, "node").groupBy("node").agg(F.sum("size").cast("int").alias("size")))
    # a name is given up once at most, for a smaller one: the merges are trees
    return components(merges.all().select(F.col("node").alias("a"), F.col("into").alias("b"))).select("node", F.col("component").alias("cluster"))


def quality(pairs: DataFrame, clusters: DataFrame, *, least: int = 2, most: int = 100) -> DataFrame:
    """cluster, size, quality: mean similarity of all of a cluster's pairs (0 for those not in
    the table), times 0.8 if the size is out of bounds."""
    x, y = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    inside = pairs.join(x, "a").join(y, "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("score").alias("total"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    n = F.col("size")
    mean = F.when(n > 1, F.coalesce("total", F.lit(0.0)) / (n * (n - 1) / 2)).otherwise(1.0)
    return size.join(inside, "cluster", "left").select("cluster", "size", (mean * F.when(n.between(least, most), 1.0).otherwise(0.8)).alias("quality"))


def assigned(pairs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """node, cluster, similarity: new nodes (a of pairs) with the cluster that they are most
    similar to on average over its members (b; none in the table counts as 0), if that reaches
    the threshold; of equals the smallest cluster."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    met = pairs.join(clusters.select(F.col("node").alias("b"), "cluster"), "b").groupBy("a", "cluster").agg(F.sum("score").alias("total")).join(size, "cluster")
    best = met.select(F.col("a").alias("node"), "cluster", (F.col("total") / F.col("size")).alias("similarity")).where(F.col("similarity") >= threshold)
    return best.groupBy("node").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "cluster")).alias("o")).select("node", "o.cluster", (-F.col("o.less")).alias("similarity"))
