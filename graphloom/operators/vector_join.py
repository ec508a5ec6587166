"""Threshold join of vectors: all pairs whose cosine reaches a bound, without a product.

Angles between vectors are distances. Each vector is at home with the nearest of a few pivots.
If x and y are within an angle t of each other and x is at home with pivot i, y is not farther
from i than from its own pivot by more than 2 t; so y also visits every pivot that near, and
no pair is missed. Hosts and visitors of a pivot are dealt to cells of BLOCK by BLOCK vectors,
about; in a cell a product of matrices finds the pairs, and their cosines are added up
one by one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators.loops import Saved

BLOCK = 16_000  # vectors on either side of a cell
CHUNK = 4_000_000  # products that a cell holds at a time
SLACK = 1e-7  # for rounding of angles


def similar_pairs(rows: DataFrame, bound: float, *, key: str, vector: str, pivots: int = 32) -> DataFrame:
    """(a, b, cosine), a < b, of rows whose vectors have a cosine of `bound` (above 0) or more.
    Vectors that are null, hold nulls or other than finite numbers, or have no length take no
    part; keys are distinct. Pivots are the `pivots` vectors with the smallest hashes."""
    if not 0 < bound <= 1:
        raise ValueError("a bound above 0, of 1 at most")
    angle = math.acos(bound)
    saved = Saved(rows.sparkSession, "similar")
    v = V.doubles(F.col(vector))
    sound = rows.where(F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    size = V.norm(F.col("v"))
    unit = sound.select(F.col(key).alias("id"), v.alias("v")).where(size > 0).select("id", F.transform("v", lambda x: x / size).alias("v"))
    unit = saved.save(unit)
    chosen = [r.v for r in unit.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]  # `pivots` vectors
    if not chosen:
        return unit.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine"))
    stars = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in chosen])
    turned = lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("v"), p))))
    angles = saved.save(unit.select("id", "v", F.transform(stars, turned).alias("angles")))
    nearest = F.array_min("angles")
    at_home = (F.array_position("angles", nearest) - 1).cast("int")
    placed = saved.save(angles.select("id", "v", "angles", nearest.alias("least"), at_home.alias("home")))
    # of two pivots the pair meets at the first: a vector visits none behind its own
    seen = placed.select("id", "v", "least", "home", F.posexplode("angles").alias("pivot", "angle")).where((F.col("pivot") <= F.col("home")) & (F.col("angle") <= F.col("least") + 2 * angle + SLACK))
    counts = seen.groupBy("pivot").agg(F.ceil(F.count_if(F.col("pivot") == F.col("home")) / BLOCK).cast("int").alias("hosts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("guests"))
    counts = F.broadcast(saved.save(counts.where("hosts > 0")))  # a row for each pivot
    at = seen.join(counts, "pivot")
    hash_ = F.xxhash64("id")
    host = at.where("pivot = home").select("pivot", F.pmod(hash_, F.col("hosts")).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("g"), F.lit(True).alias("host"), "home", "id", "v")
    guest = at.select("pivot", F.explode(F.sequence(F.lit(0), F.col("hosts") - 1)).alias("h"), F.pmod(hash_, F.col("guests")).cast("int").alias("g"), F.lit(False).alias("host"), "home", "id", "v")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        lengths = pc.list_value_length(cell["v"])
        for n in pc.unique(lengths).to_pylist():
            of_length = cell.filter(pc.equal(lengths, n))
            sides = [of_length.filter(of_length["host"]), of_length.filter(pc.invert(of_length["host"]))]
            x, y = (np.concatenate([np.asarray(c.flatten()) for c in t["v"].chunks] or [np.zeros(0)]).reshape(-1, n) for t in sides)
            ids, homes = [t["id"].combine_chunks() for t in sides], [t["home"].to_numpy() for t in sides]
            step = max(1, CHUNK // max(1, len(y)))
            for k in range(0, len(x), step):
                i, j = np.nonzero(x[k : k + step] @ y.T >= bound - 1e-9)
                i += k
                cosine = np.zeros(len(i))
                for d in range(n):  # added up in the order of `dot`
                    cosine += x[i, d] * y[j, d]
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(homes[0][i] == homes[1][j]), pa.array(cosine)], names=["x", "y", "twice", "cosine"])

    kind = rows.schema[key].dataType.simpleString()
    met = host.union(guest).groupBy("pivot", "h", "g").applyInArrow(products, f"x {kind}, y {kind}, twice boolean, cosine double")
    met = met.where((F.col("cosine") >= bound) & (~F.col("twice") | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
