"""Temporal operators. Two validity rules are kept apart: facts are half-open after
truncation to a granularity, context nodes and edges are closed without truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 23:59:59.999999"
GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def truncated(ts: Column, grain: str = "day") -> Column:
    if grain not in GRAINS:
        raise ValueError(f"unknown granularity {grain}")
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def active_half_open(start: Column, end: Column, at: Column, grain: str = "day") -> Column:
    """start <= at < end, each truncated; an open end never ends."""
    a, b, t = truncated(start, grain), truncated(end, grain), truncated(at, grain)
    return (a.isNull() | (a <= t)) & (b.isNull() | (t < b))


def active_closed(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (at >= start)) & (end.isNull() | (at <= end))


def overlaps_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Any overlap with [low, high], touching included."""
    return (start.isNull() | (start <= high)) & (end.isNull() | (end >= low))


def covers_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start.isNull() | (start <= low)) & (end.isNull() | (end >= high))


def snapshot(edges: DataFrame, at: Column, *, nodes: DataFrame | None = None, grain: str = "day") -> DataFrame:
    """Edges valid at `at`; with nodes (id, valid_from, valid_until), both ends must be too."""
    live = edges.where(active_half_open(F.col("valid_from"), F.col("valid_until"), at, grain))
    if nodes is None:
        return live
    alive = nodes.where(active_half_open(F.col("valid_from"), F.col("valid_until"), at, grain)).select("id")
    return live.join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")


def allen(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Allen's relation of [a1, a2] to [b1, b2]; an open end is the last instant."""
    last = F.lit(FOREVER).cast("timestamp_ntz")
    a2, b2 = F.coalesce(a2, last), F.coalesce(b2, last)
    return (
        F.when(a2 < b1, "before").when(a1 > b2, "after").when(a2 == b1, "meets").when(a1 == b2, "met_by")
        .when((a1 == b1) & (a2 == b2), "equals").when((a1 == b1) & (a2 < b2), "starts").when(a1 == b1, "started_by")
        .when((a2 == b2) & (a1 > b1), "finishes").when(a2 == b2, "finished_by")
        .when((a1 > b1) & (a2 < b2), "during").when((a1 < b1) & (a2 > b2), "contains")
        .when(a1 < b1, "overlaps").otherwise("overlapped_by")
    )


def merged(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of each key's intervals; touching ones become one."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def _inside(intervals: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """The intervals cut to [low, high], and one without length at low for every key."""
    cut = intervals.where((F.col(end) > low) & (F.col(start) < high)).select(key, F.greatest(F.col(start), low).alias(start), F.least(F.col(end), high).alias(end))
    return cut.union(intervals.select(key, low.alias(start), low.alias(end)).distinct())


def gaps(intervals: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """What of [low, high] no interval of the key covers; all of it for a key whose intervals
    lie outside."""
    joined = merged(_inside(intervals, key, start, end, low, high), key, start, end)
    order = Window.partitionBy(key).orderBy(start)
    between = joined.select(key, F.coalesce(F.lag(end).over(order), low).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = joined.groupBy(key).agg(F.max(end).alias("gap_start")).select(key, "gap_start", high.alias("gap_end"))
    return between.union(tail).where("gap_start < gap_end")


def coverage(intervals: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Covered share of [low, high] for each key; 0 for a key whose intervals lie outside."""

    def seconds(a: Column, b: Column) -> Column:
        return F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))

    return merged(_inside(intervals, key, start, end, low, high), key, start, end).groupBy(key).agg((F.sum(seconds(F.col(start), F.col(end))) / F.first(seconds(low, high))).alias("coverage"))


def timeline(facts: DataFrame, key: str) -> DataFrame:
    """(key, ts, change): added, modified, removed, superseded events of each fact."""
    def event(ts: str, change: str, when: Column) -> Column:
        return F.when(when & F.col(ts).isNotNull(), F.struct(F.col(ts).alias("ts"), F.lit(change).alias("change")))

    events = F.array(
        event("valid_from", "added", F.lit(True)),
        event("recorded_at", "modified", ~F.col("recorded_at").eqNullSafe(F.col("valid_from"))),
        event("valid_until", "removed", F.lit(True)),
    )
    return facts.select(key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(key, "e.ts", "e.change")


def consistency(edges: DataFrame) -> DataFrame:
    """Overlaps and gaps of an edge with the one before it (same src, type, dst), and
    inverted intervals."""
    order = Window.partitionBy("src", "type", "dst").orderBy("valid_from", "valid_until", "id")
    seen = edges.withColumn("before", F.lag("valid_until").over(order))
    problem = F.when(F.col("valid_until") < F.col("valid_from"), "inverted").when(F.col("before") > F.col("valid_from"), "overlap").when(F.col("before") < F.col("valid_from"), "gap")
    return seen.select("id", "src", "type", "dst", problem.alias("problem")).where("problem is not null")


def retroactive(revision_start: Column, revision_end: Column, start: Column, end: Column) -> Column:
    return F.when((start <= revision_start) & (end >= revision_end), "affected").when((start <= revision_end) & (end >= revision_start), "partial").otherwise("unaffected")


def evolution(edges: DataFrame, grain: str) -> DataFrame:
    """Edges that begin in each period: count and distinct types."""
    return edges.groupBy(truncated(F.col("valid_from"), grain).alias("period")).agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str) -> DataFrame:
    """Each left row with the last right row of its key at or before its time, by one union
    and one window: no row pairs are formed. Right columns are null if there is none."""
    rights = [c for c in right.columns if c != key]
    lefts = [c for c in left.columns if c != key]
    a = left.select(key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*lefts).alias("_l"), F.lit(None).cast(right.select(F.struct(*rights).alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*rights).alias("_r"))
    order = Window.partitionBy(key).orderBy("_t", "_side", *[F.col(f"_r.{c}") for c in rights]).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1").select(key, "_l.*", "_r.*")


def sequences(events: DataFrame, key: str, ts: str, kind: str, length: int, min_count: int) -> DataFrame:
    """Frequent runs of `length` consecutive event kinds of a key."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    steps = [F.lead(kind, k).over(order) if k else F.col(kind) for k in range(length)]
    runs = events.select(F.concat_ws(">", *steps).alias("pattern"), F.lead(kind, length - 1).over(order).alias("_end") if length > 1 else F.col(kind).alias("_end"))
    return runs.where("_end is not null").groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def paths(edges: DataFrame, source: str, target: str, *, low: Column, high: Column, max_nodes: int, ordering: str = "strict") -> DataFrame:
    """(path, edges): simple directed paths over edges (src, dst, start, end) that overlap
    [low, high]. ordering: strict, an edge starts no earlier than the one before; overlap, it
    starts no later than the one before ends; loose, any. An open bound bounds nothing."""
    late = {"strict": F.col("start") < F.col("before.start"), "overlap": F.col("start") > F.col("before.end"), "loose": F.lit(False)}[ordering]
    links = edges.where(overlaps_range(F.col("start"), F.col("end"), low, high)).select("src", "dst", "start", "end")
    first = links.where(F.col("src") == source)
    now = first.select(F.array("src", "dst").alias("path"), F.struct("start", "end").alias("before"))
    found = None
    for size in range(2, max_nodes + 1):
        hit = now.where(F.element_at("path", -1) == target).select("path")
        found = hit if found is None else found.union(hit)
        if size < max_nodes:
            grown = now.where(F.element_at("path", -1) != target).join(links, F.element_at("path", -1) == F.col("src"))
            grown = grown.where(~F.array_contains("path", F.col("dst")) & ~F.coalesce(late, F.lit(False)))
            now = grown.select(F.concat("path", F.array("dst")).alias("path"), F.struct("start", "end").alias("before"))
    return found.groupBy(F.array_join("path", ">").alias("path")).agg(F.count("*").alias("ways"))


def phrase(text: Column, today: Column) -> Column:
    """struct<start, end> (end exclusive) of a relative phrase: today, yesterday, this or last
    week, month, quarter or year, n days, months or years ago; null for any other."""
    low = F.lower(F.trim(text))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))

    out = F.when(low == "today", span(today, F.date_add(today, 1))).when(low == "yesterday", span(F.date_sub(today, 1), today))
    for unit, days, months in (("week", 7, 0), ("month", 0, 1), ("quarter", 0, 3), ("year", 0, 12)):
        begin = F.date_trunc(unit, today)
        after, before = (F.date_add(begin, days), F.date_sub(begin, days)) if days else (F.add_months(begin, months), F.add_months(begin, -months))
        out = out.when(low == f"this {unit}", span(begin, after)).when(low == f"last {unit}", span(before, begin))
    n = F.regexp_extract(low, r"^([0-9]+) (?:days?|months?|years?) ago$", 1).try_cast("int")
    out = out.when(low.rlike(r"^[0-9]+ days? ago$"), span(F.date_sub(today, n), F.date_add(F.date_sub(today, n), 1)))
    for unit, months in (("month", 1), ("year", 12)):
        begin = F.add_months(today, -n * months)
        out = out.when(low.rlike(rf"^[0-9]+ {unit}s? ago$"), span(F.date_trunc(unit, begin), F.add_months(F.date_trunc(unit, begin), months)))
    return out
