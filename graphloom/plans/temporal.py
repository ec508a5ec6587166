"""Temporal queries over orders (valid from order date to last shipment) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import temporal as T
from graphloom.sources.tables import node, table

Q, S = {}, {}
V = "v AS (SELECT o_orderkey AS id, 'c' || o_custkey AS src, o_orderpriority AS type, o_orderstatus AS dst, o_orderdate AS valid_from, max(l_shipdate) AS valid_until, min(l_shipdate) AS recorded_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def stay(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("valid_until"), F.min("l_shipdate").alias("recorded_at"))
    orders = table(spark, sf, "orders")
    return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), node("c", "o_custkey").alias("src"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("dst"), F.col("o_orderdate").alias("valid_from"), "valid_until", "recorded_at")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@query("temporal_snapshot", f"WITH {V} SELECT id, src, type FROM v WHERE date_trunc('day', valid_from) <= TIMESTAMP '1999-06-01' AND (valid_until IS NULL OR date_trunc('day', valid_until) > TIMESTAMP '1999-06-01')")
def _(spark, sf):
    return T.snapshot(stay(spark, sf), ts("1999-06-01 00:00:00")).select("id", "src", "type")


@query("temporal_snapshot_monthly", f"WITH {V} SELECT id, src, type FROM v WHERE date_trunc('month', valid_from) <= TIMESTAMP '1999-06-01' AND (valid_until IS NULL OR date_trunc('month', valid_until) > TIMESTAMP '1999-06-01')")
def _(spark, sf):
    return T.snapshot(stay(spark, sf), ts("1999-06-15 00:00:00"), grain="month").select("id", "src", "type")


@query("temporal_state_at_closed", f"WITH {V} SELECT id, src FROM v WHERE valid_from <= TIMESTAMP '1999-06-01' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1999-06-01')")
def _(spark, sf):
    return stay(spark, sf).where(T.active_closed(F.col("valid_from"), F.col("valid_until"), ts("1999-06-01 00:00:00"))).select("id", "src")


@query("temporal_range_union", f"WITH {V} SELECT id FROM v WHERE valid_from <= TIMESTAMP '1999-03-01' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1999-02-01')")
def _(spark, sf):
    return stay(spark, sf).where(T.overlaps_range(F.col("valid_from"), F.col("valid_until"), ts("1999-02-01 00:00:00"), ts("1999-03-01 00:00:00"))).select("id")


@query("temporal_range_intersection", f"WITH {V} SELECT id FROM v WHERE valid_from <= TIMESTAMP '1999-02-01' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1999-02-10')")
def _(spark, sf):
    return stay(spark, sf).where(T.covers_range(F.col("valid_from"), F.col("valid_until"), ts("1999-02-01 00:00:00"), ts("1999-02-10 00:00:00"))).select("id")


@query("temporal_evolution", f"WITH {V} SELECT strftime(date_trunc('month', valid_from), '%Y-%m') AS period, count(*) AS n, count(DISTINCT type) AS types FROM v GROUP BY 1")
def _(spark, sf):
    return T.evolution(stay(spark, sf), "month").withColumn("period", F.date_format("period", "yyyy-MM"))


_CASE = """CASE WHEN a2 < b1 THEN 'before' WHEN a1 > b2 THEN 'after' WHEN a2 = b1 THEN 'meets' WHEN a1 = b2 THEN 'met_by' WHEN a1 = b1 AND a2 = b2 THEN 'equals' WHEN a1 = b1 AND a2 < b2 THEN 'starts' WHEN a1 = b1 THEN 'started_by' WHEN a2 = b2 AND a1 > b1 THEN 'finishes' WHEN a2 = b2 THEN 'finished_by' WHEN a1 > b1 AND a2 < b2 THEN 'during' WHEN a1 < b1 AND a2 > b2 THEN 'contains' WHEN a1 < b1 THEN 'overlaps' ELSE 'overlapped_by' END"""


@query("temporal_allen_relations", f"WITH {V}, w AS (SELECT id, valid_from AS a1, valid_until AS a2, lead(id) OVER o AS other, lead(valid_from) OVER o AS b1, lead(valid_until) OVER o AS b2 FROM v WHERE valid_until IS NOT NULL WINDOW o AS (PARTITION BY src ORDER BY id)) SELECT id, other, {_CASE} AS relation FROM w WHERE other IS NOT NULL")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy("id")
    pairs = stay(spark, sf).where("valid_until is not null").select("id", F.col("valid_from").alias("a1"), F.col("valid_until").alias("a2"), F.lead("id").over(w).alias("other"), F.lead("valid_from").over(w).alias("b1"), F.lead("valid_until").over(w).alias("b2")).where("other is not null")
    return pairs.select("id", "other", T.allen(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("relation"))


_M = V + """, o AS (SELECT DISTINCT src, valid_from AS s, valid_until AS e FROM v WHERE valid_until > valid_from),
k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY src ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM k),
m AS (SELECT src, min(s) AS s, max(e) AS e FROM i GROUP BY src, island)"""


@query("temporal_merge_intervals", f"WITH {_M} SELECT src, CAST(s AS VARCHAR) AS valid_from, CAST(e AS VARCHAR) AS valid_until FROM m")
def _(spark, sf):
    rows = stay(spark, sf).where("valid_until > valid_from").select("src", "valid_from", "valid_until")
    return T.merged(rows, "src", "valid_from", "valid_until").select("src", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"))


_R = V + """, o AS (SELECT DISTINCT src, greatest(valid_from, TIMESTAMP '1998-01-01') AS s, least(valid_until, TIMESTAMP '1999-01-01') AS e FROM v WHERE valid_until > valid_from AND valid_until > TIMESTAMP '1998-01-01' AND valid_from < TIMESTAMP '1999-01-01' UNION SELECT src, TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-01' FROM v WHERE valid_until > valid_from),
k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY src ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM k),
m AS (SELECT src, min(s) AS s, max(e) AS e FROM i GROUP BY src, island)"""


@query("temporal_gaps", f"WITH {_R}, g AS (SELECT src, coalesce(lag(e) OVER (PARTITION BY src ORDER BY s), TIMESTAMP '1998-01-01') AS a, s AS b FROM m UNION ALL SELECT src, max(e), TIMESTAMP '1999-01-01' FROM m GROUP BY src) SELECT src, CAST(a AS VARCHAR) AS gap_start, CAST(b AS VARCHAR) AS gap_end FROM g WHERE a < b")
def _(spark, sf):
    rows = stay(spark, sf).where("valid_until > valid_from").select("src", "valid_from", "valid_until")
    out = T.gaps(rows, "src", "valid_from", "valid_until", ts("1998-01-01 00:00:00"), ts("1999-01-01 00:00:00"))
    return out.select("src", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"))


@query("temporal_coverage", f"WITH {_R} SELECT src, round(sum(epoch_us(e) - epoch_us(s)) / (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(TIMESTAMP '1998-01-01')), 9) AS coverage FROM m GROUP BY src")
def _(spark, sf):
    rows = stay(spark, sf).where("valid_until > valid_from").select("src", "valid_from", "valid_until")
    return T.coverage(rows, "src", "valid_from", "valid_until", ts("1998-01-01 00:00:00"), ts("1999-01-01 00:00:00")).withColumn("coverage", F.round("coverage", 9))


@query("temporal_timeline", f"WITH {V} SELECT id, CAST(valid_from AS VARCHAR) AS ts, 'added' AS change FROM v UNION ALL SELECT id, CAST(recorded_at AS VARCHAR), 'modified' FROM v WHERE recorded_at IS NOT NULL AND recorded_at <> valid_from UNION ALL SELECT id, CAST(valid_until AS VARCHAR), 'removed' FROM v WHERE valid_until IS NOT NULL")
def _(spark, sf):
    return T.timeline(stay(spark, sf), "id").withColumn("ts", F.col("ts").cast("string"))


@query("temporal_consistency", f"WITH {V}, w AS (SELECT *, lag(valid_until) OVER (PARTITION BY src, type, dst ORDER BY valid_from, valid_until NULLS FIRST, id) AS before FROM v), p AS (SELECT id, src, type, dst, CASE WHEN valid_until < valid_from THEN 'inverted' WHEN before > valid_from THEN 'overlap' WHEN before < valid_from THEN 'gap' END AS problem FROM w) SELECT * FROM p WHERE problem IS NOT NULL")
def _(spark, sf):
    return T.consistency(stay(spark, sf))


@query("temporal_retroactive", f"WITH {V} SELECT id, CASE WHEN valid_from <= TIMESTAMP '1999-01-01' AND valid_until >= TIMESTAMP '1999-02-01' THEN 'affected' WHEN valid_from <= TIMESTAMP '1999-02-01' AND valid_until >= TIMESTAMP '1999-01-01' THEN 'partial' ELSE 'unaffected' END AS effect FROM v")
def _(spark, sf):
    return stay(spark, sf).select("id", T.retroactive(ts("1999-01-01 00:00:00"), ts("1999-02-01 00:00:00"), F.col("valid_from"), F.col("valid_until")).alias("effect"))


@query("temporal_diff", f"WITH {V}, a AS (SELECT DISTINCT src FROM v WHERE valid_from <= TIMESTAMP '1998-01-01' AND valid_until >= TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT src FROM v WHERE valid_from <= TIMESTAMP '1998-02-01' AND valid_until >= TIMESTAMP '1998-02-01') SELECT src, 'added' AS change FROM b WHERE src NOT IN (SELECT src FROM a) UNION ALL SELECT src, 'removed' FROM a WHERE src NOT IN (SELECT src FROM b)")
def _(spark, sf):
    def at(t):
        return stay(spark, sf).where((F.col("valid_from") <= t) & (F.col("valid_until") >= t)).select("src").distinct()

    a, b = at(ts("1998-01-01 00:00:00")), at(ts("1998-02-01 00:00:00"))
    return b.join(a, "src", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "src", "left_anti").withColumn("change", F.lit("removed")))


@query("temporal_bounds", f"WITH {V} SELECT CAST(min(valid_from) AS VARCHAR) AS first, CAST(max(greatest(valid_from, valid_until)) AS VARCHAR) AS last FROM v")
def _(spark, sf):
    return stay(spark, sf).agg(F.min("valid_from").cast("string").alias("first"), F.max(F.greatest("valid_from", "valid_until")).cast("string").alias("last"))


@query("temporal_as_of_join", "WITH e AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS view_ts, event_id AS view_id FROM events WHERE event_type = 'view') SELECT e.event_id, e.user_id, v.view_id FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.view_ts")
def _(spark, sf):
    events = table(spark, sf, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return T.as_of(left, right, "user_id", "ts", "view_ts").select("event_id", "user_id", "view_id")


@query("temporal_normalised", "SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week, strftime(date_trunc('quarter', ts), '%Y-%m-%d %H:%M:%S') AS quarter, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events")
def _(spark, sf):
    def text(grain):
        return F.date_format(T.truncated(F.col("ts"), grain), "yyyy-MM-dd HH:mm:ss").alias(grain)

    return table(spark, sf, "events").select("event_id", text("week"), text("quarter"), text("hour"))


@query("temporal_causal_chain", "WITH RECURSIVE c AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cause FROM events), w AS (SELECT id AS start, cause AS node, 1 AS hops FROM c WHERE cause IS NOT NULL UNION ALL SELECT start, cause, hops + 1 FROM w JOIN c ON c.id = w.node WHERE cause IS NOT NULL AND hops < 5) SELECT start, node, hops FROM w")
def _(spark, sf):
    """Of every event the five before it of the same user, each the cause of the next."""
    from pyspark.sql import Window

    from graphloom.operators.loops import reachable

    events = table(spark, sf, "events")
    links = events.select(F.col("event_id").alias("src"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).where("dst is not null")
    return reachable(links, events.select(F.col("event_id").alias("start")), max_hops=5).where("hops > 0")