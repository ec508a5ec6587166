"""Interval against interval: all overlapping pairs, without a product of the tables.

Time is cut into bins at several levels, each FAN times as wide as the one below. An interval
is at home at the lowest level whose bins are no shorter than itself, so it lies in two bins
at most there and at every level above. A pair is looked for at the higher of its two homes, and
put out in the one bin that holds the start of the overlap, so once. A bin with many rows is
dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved

FAN = 8
BLOCK = 1000  # left rows of a bin that one task meets with the bin's right rows
#: Bounds of an open interval: microseconds of the years 1 and 9999.
ALWAYS, NEVER = -62_135_596_800_000_000, 253_402_300_799_999_999


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _widths(width: int) -> list[int]:
    out = [width]
    while out[-1] < NEVER - ALWAYS:
        out.append(out[-1] * FAN)
    return out


def _bin(x: Column, width: Column) -> Column:
    return x - F.pmod(x, width)


def _homed(rows: DataFrame, on: list[str], start: str, end: str, name: str, widths: list[int]) -> DataFrame:
    low, high = F.coalesce(F.col(start).cast("long"), F.lit(ALWAYS)), F.coalesce(F.col(end).cast("long"), F.lit(NEVER))
    out = rows.select(*on, low.alias(f"{name}_low"), high.alias(f"{name}_high"), F.struct(*[c for c in rows.columns if c not in on]).alias(name)).where(F.col(f"{name}_low") <= F.col(f"{name}_high"))
    length = F.col(f"{name}_high") - F.col(f"{name}_low")
    return out.withColumn(f"{name}_home", sum(((length > w).cast("int") for w in widths[:-1]), F.lit(0)))


def _binned(rows: DataFrame, name: str, levels: list[int], widths: list[int]) -> DataFrame:
    """A row for each bin of each level, from the row's home up, at which there are homes."""
    wanted = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(widths[k]).cast("long").alias("width")) for k in levels])
    each = rows.select("*", F.explode(F.filter(wanted, lambda x: x["level"] >= F.col(f"{name}_home"))).alias("_at"))
    bins = F.sequence(_bin(F.col(f"{name}_low"), F.col("_at.width")), _bin(F.col(f"{name}_high"), F.col("_at.width")), F.col("_at.width"))
    return each.select("*", F.col("_at.level").alias("_level"), F.col("_at.width").alias("_width"), F.explode(bins).alias("_bin")).drop("_at")


def overlap_join(left: DataFrame, right: DataFrame, *, on: list[str], start: str = "start", end: str = "end", touching: bool = True, width: int = 3_600_000_000) -> DataFrame:
    """on, l, r: pairs of rows (as structs of their other columns) that are equal in the columns
    `on` and whose intervals [start, end] (numbers, such as `micros` gives) share an instant;
    with touching=False, more than one. An open bound (null) has no end; an interval that ends
    before it starts meets nothing. `width` is that of the narrowest bins."""
    widths = _widths(width)
    saved = Saved(left.sparkSession, "overlaps")
    a, b = saved.save(_homed(left, on, start, end, "l", widths)), saved.save(_homed(right, on, start, end, "r", widths))
    # as many values as there are levels, at most
    levels = sorted({r[0] for r in a.select("l_home").union(b.select("r_home")).distinct().collect()})
    if not levels:
        levels = [0]
    a, b = _binned(a, "l", levels, widths), _binned(b, "r", levels, widths).drop("_width")
    keys = [*on, "_level", "_bin"]
    parts = a.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts"))
    if (parts.agg(F.max("_parts")).first()[0] or 1) > 1:
        parts = saved.save(parts)
        a = a.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("l"), F.col("_parts"))).drop("_parts")
        b = b.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_parts") - 1).cast("long")))).drop("_parts")
        keys.append("_part")
    meets = (F.col("l_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("l_high"))
    if not touching:
        meets = (F.col("l_low") < F.col("r_high")) & (F.col("r_low") < F.col("l_high"))
    here = (F.col("_level") == F.greatest("l_home", "r_home")) & (F.col("_bin") == _bin(F.greatest("l_low", "r_low"), F.col("_width")))
    return a.join(b, keys).where(meets & here).select(*on, "l", "r")
