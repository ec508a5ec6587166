"""Causes and effects of decisions over typed links: what led to a decision and how strongly,
where it began, and how much followed from it.

Links are rows (cause, effect, type, weight), weight from 0 to 1. All starts are followed at
once: a round is one join of the labels reached last with the links, and a label is a row, so
the work is that of the (start, decision) pairs within `max_hops` and not of the paths between
them.

Defined cases: of several links between two decisions the heaviest counts; a decision is never
its own cause, though a loop may lead back to it; links with a null end are no links, a null
weight counts as 1; a start without causes has no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved, reachable

#: The types of links that make a cause.
CAUSAL = ("CAUSED", "INFLUENCED")
PRECEDENT = ("PRECEDENT_FOR",)


def _links(links: DataFrame, types: tuple[str, ...]) -> DataFrame:
    rows = links.where(F.col("type").isin(*types) & F.col("cause").isNotNull() & F.col("effect").isNotNull() & (F.col("cause") != F.col("effect")))
    return rows.groupBy("cause", "effect").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("w"))


def reports(links: DataFrame, starts: DataFrame, *, max_hops: int = 5, types: tuple[str, ...] = CAUSAL + PRECEDENT) -> DataFrame:
    """start, cause, hops, strength, weakest: every decision that leads to a start within
    `max_hops`, by the way with the greatest product of weights; of equal products the way with
    fewer links, then the one whose weakest link is stronger."""
    saved = Saved(links.sparkSession, "causes")
    steps = saved.save(_links(links, types).withColumnsRenamed({"cause": "_cause", "effect": "_effect"}))
    best = F.struct("strength", (-F.col("hops")).alias("fewer"), "weakest")
    first = starts.select("start").distinct().select("start", F.col("start").alias("cause"), F.lit(1.0).alias("strength"), F.lit(0).alias("hops"), F.lit(1.0).alias("weakest"))
    frontier, found = first, []
    for _ in range(max_hops):
        # of the ways with as many links, the best one to each decision goes on
        on = frontier.join(steps, F.col("cause") == F.col("_effect"))
        on = on.select("start", F.col("_cause").alias("cause"), (F.col("strength") * F.col("w")).alias("strength"), (F.col("hops") + 1).alias("hops"), F.least("weakest", "w").alias("weakest"))
        frontier = saved.save(on.groupBy("start", "cause").agg(F.max(best).alias("b")).select("start", "cause", "b.strength", (-F.col("b.fewer")).alias("hops"), "b.weakest"))
        found.append(frontier)
        if frontier.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    top = every.where("start != cause").groupBy("start", "cause").agg(F.max(best).alias("b"))
    return top.select("start", "cause", (-F.col("b.fewer")).alias("hops"), "b.strength", "b.weakest")


def roots(links: DataFrame, starts: DataFrame, *, max_hops: int = 10, types: tuple[str, ...] = CAUSAL) -> DataFrame:
    """start, cause, hops: the decisions that lead to a start and have no cause themselves, and
    how far they are."""
    steps = Saved(links.sparkSession, "roots").save(_links(links, types).select(F.col("effect").alias("src"), F.col("cause").alias("dst")))
    near = reachable(steps, starts.select("start").distinct(), max_hops=max_hops).where("hops > 0")
    least = near.groupBy("start", F.col("node").alias("cause")).agg(F.min("hops").alias("hops"))
    return least.join(steps.select(F.col("src").alias("cause")).distinct(), "cause", "left_anti").select("start", "cause", "hops")


def impact(links: DataFrame, decisions: DataFrame, *, max_hops: int = 5) -> DataFrame:
    """decision, influenced, precedents, score: how many other decisions follow from each within
    `max_hops`, how many it has as precedents, and their confidence against their number, a
    precedent at half weight (0 to 1). `decisions` has decision and confidence (null: 0)."""
    starts = decisions.select(F.col("decision").alias("start")).distinct()
    sure = decisions.groupBy(F.col("decision").alias("node")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))

    def told(name: str, steps: DataFrame) -> DataFrame:
        near = reachable(steps, starts, max_hops=max_hops).where("hops > 0 AND start != node").select("start", "node").distinct()
        return near.join(sure, "node").groupBy("start").agg(F.count("*").alias(name), F.sum("c").alias(f"_{name}"))

    follows = told("influenced", _links(links, CAUSAL).select(F.col("cause").alias("src"), F.col("effect").alias("dst")))
    before = told("precedents", _links(links, PRECEDENT).select(F.col("effect").alias("src"), F.col("cause").alias("dst")))
    rows = starts.join(follows, "start", "left").join(before, "start", "left").na.fill(0)
    size = F.greatest("influenced", F.lit(1)) + 0.5 * F.greatest("precedents", F.lit(1))
    score = F.least((F.col("_influenced") + 0.5 * F.col("_precedents")) / size, F.lit(1.0))
    return rows.select(F.col("start").alias("decision"), "influenced", "precedents", score.alias("score"))
