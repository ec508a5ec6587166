"""Ranking and fusion of results, keyword search, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators.loops import Saved, ranked


def top_similar(rows: DataFrame, query: list[float], k: int, *, key: str, vector: str, method: str = "cosine") -> DataFrame:
    """The k rows most similar to one query vector, ties by key."""
    q, v = F.array(*[F.lit(float(x)) for x in query]), V.doubles(F.col(vector))
    score = {"cosine": lambda: V.cosine(v, q), "correlation": lambda: V.correlation(v, q), "euclidean": lambda: V.closeness(V.euclidean(v, q)), "manhattan": lambda: V.closeness(V.manhattan(v, q))}[method]()
    return rows.select(key, F.round(score, 9).alias("score")).orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(results: DataFrame, *, k: int = 60) -> DataFrame:
    """results: source, id, score. Sum over sources of 1 / (k + rank). A source's results are
    ranked by many tasks."""
    placed = ranked(results.select("source", "id", "score"), "source", F.desc("score"), "id")
    return placed.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def weighted_fusion(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.lit(1.0 / max(1, len(weights)))
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    return results.groupBy("id").agg(F.sum(F.col("score") * weight).alias("score"))


def min_max_merged(results: DataFrame) -> DataFrame:
    """Scores of each source brought to [0, 1] (as they are if all are equal); of an id the
    best counts, raised by a fifth if more than one source has it."""
    ends = Saved(results.sparkSession, "ends").save(results.groupBy("source").agg(F.min("score").alias("low"), F.max("score").alias("high")))
    low, high = F.col("low"), F.col("high")
    # one row a source, of a size that is known: it is sent to the results, not they to it
    scaled = results.join(ends, "source").withColumn("s", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))
    return scaled.groupBy("id").agg((F.max("s") * F.when(F.countDistinct("source") > 1, 1.2).otherwise(1.0)).alias("score"))


def keyword_search(rows: DataFrame, query: str, *, text: str) -> DataFrame:
    """Rows whose lower-cased text holds a token of the query; score: share of its tokens."""
    tokens = query.lower().split()
    low = F.lower(F.col(text))
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0)) / len(tokens)
    return rows.withColumn("score", score).where("score > 0")


def filtered(rows: DataFrame, conditions: dict) -> DataFrame:
    """{field: value | list | {min, max}}; a null field never matches."""
    for field, want in conditions.items():
        c = F.col(field)
        if isinstance(want, dict):
            rows = rows.where(c >= want["min"]) if "min" in want else rows
            rows = rows.where(c <= want["max"]) if "max" in want else rows
        else:
            rows = rows.where(c.isin(want) if isinstance(want, (list, tuple)) else c == want)
    return rows


def budgeted(rows: DataFrame, *, key: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each key in order, as long as the running cost stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).withColumn("kept", F.col("spent") <= budget)


def pooled(rows: DataFrame, *, by: str, vector: str) -> DataFrame:
    """Mean and greatest component of each group's vectors, as (group, dim, mean, most); sums
    are partial, so no group is gathered."""
    parts = rows.select(by, F.posexplode(V.doubles(F.col(vector))).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("most"))
