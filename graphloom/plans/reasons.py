"""Whether arguments hold, what led to decisions and what followed from them: orders, each influenced by the customer's
order before it if that is near in time, with the last one of the same priority as precedent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import causes as CA
from graphloom.operators import rules as R
from graphloom.sources.tables import node, table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_NEAR = 120  # days
_LINKS = f"""o AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderdate AS t, 0.5 + 0.05 * (o_orderkey % 10)::DOUBLE AS confidence FROM orders),
n AS (SELECT id, t, lag(id) OVER c AS last, lag(t) OVER c AS last_t, lag(id) OVER p AS same FROM o WINDOW c AS (PARTITION BY o_custkey ORDER BY t, id), p AS (PARTITION BY o_custkey, o_orderpriority ORDER BY t, id)),
l AS (SELECT last AS cause, n.id AS effect, CASE WHEN date_diff('day', last_t, n.t) <= 30 THEN 'CAUSED' ELSE 'INFLUENCED' END AS type, confidence AS w FROM n JOIN o ON o.id = last WHERE date_diff('day', last_t, n.t) <= {_NEAR} UNION ALL SELECT same, n.id, 'PRECEDENT_FOR', confidence FROM n JOIN o ON o.id = same)"""


def _links(spark, sf):
    """Decisions with their confidence, and links between them; a link weighs its cause's."""
    confidence = 0.5 + 0.05 * (F.col("o_orderkey") % 10)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("t"), confidence.alias("confidence"))
    it = F.struct("id", "t", "confidence")
    seen = o.select("id", "t", F.lag(it).over(Window.partitionBy("o_custkey").orderBy("t", "id")).alias("last"), F.lag(it).over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("t", "id")).alias("same"))
    days = F.date_diff("t", "last.t")
    near = F.when(days <= _NEAR, F.struct(F.col("last.id").alias("cause"), F.col("id").alias("effect"), F.when(days <= 30, "CAUSED").otherwise("INFLUENCED").alias("type"), F.col("last.confidence").alias("weight")))
    same = F.struct(F.col("same.id").alias("cause"), F.col("id").alias("effect"), F.lit("PRECEDENT_FOR").alias("type"), F.col("same.confidence").alias("weight"))
    links = seen.select(F.explode(F.array(near, same)).alias("l")).where("l.cause IS NOT NULL").select("l.*")
    return o.select(F.col("id").alias("decision"), "confidence"), links


@query("decision_causes", f"""WITH RECURSIVE {_LINKS}, u AS (SELECT cause, effect, max(w) AS w FROM l GROUP BY ALL),
p AS (SELECT id AS start, id AS cause, 1.0::DOUBLE AS strength, 0 AS hops, 1.0::DOUBLE AS weakest FROM o UNION ALL SELECT start, u.cause, strength * w, hops + 1, least(weakest, w) FROM p JOIN u ON u.effect = p.cause WHERE hops < 4),
r AS (SELECT *, row_number() OVER (PARTITION BY start, cause ORDER BY strength DESC, hops, weakest DESC) AS k FROM p WHERE hops > 0)
SELECT start, cause, hops, round(strength, 9) AS strength, round(weakest, 9) AS weakest FROM r WHERE k = 1""")
def _(spark, sf):
    """Every order's causes within four links, by the strongest way, and its weakest link."""
    decisions, links = _links(spark, sf)
    out = CA.reports(links, decisions.select(F.col("decision").alias("start")), max_hops=4)
    return out.withColumns({"strength": F.round("strength", 9), "weakest": F.round("weakest", 9)})


@query("decision_root_causes", f"""WITH RECURSIVE {_LINKS}, u AS (SELECT DISTINCT cause, effect FROM l WHERE type <> 'PRECEDENT_FOR'),
p AS (SELECT id AS start, id AS cause, 0 AS hops FROM o UNION ALL SELECT start, u.cause, hops + 1 FROM p JOIN u ON u.effect = p.cause WHERE hops < 10)
SELECT start, cause, min(hops)::INTEGER AS hops FROM p WHERE hops > 0 AND cause NOT IN (SELECT effect FROM u) GROUP BY ALL""")
def _(spark, sf):
    """Where the orders that lead to an order began, within ten links."""
    decisions, links = _links(spark, sf)
    return CA.roots(links, decisions.select(F.col("decision").alias("start")))


@query("decision_impact", f"""WITH RECURSIVE {_LINKS}, u AS (SELECT DISTINCT cause, effect FROM l WHERE type <> 'PRECEDENT_FOR'), v AS (SELECT DISTINCT cause, effect FROM l WHERE type = 'PRECEDENT_FOR'),
p AS (SELECT id AS start, id AS node, 0 AS hops FROM o UNION ALL SELECT start, u.effect, hops + 1 FROM p JOIN u ON u.cause = p.node WHERE hops < 5),
q AS (SELECT id AS start, id AS node, 0 AS hops FROM o UNION ALL SELECT start, v.cause, hops + 1 FROM q JOIN v ON v.effect = q.node WHERE hops < 5),
a AS (SELECT start, count(*) AS n, sum(confidence) AS s FROM (SELECT DISTINCT start, node FROM p WHERE hops > 0) JOIN o ON o.id = node GROUP BY 1), b AS (SELECT start, count(*) AS n, sum(confidence) AS s FROM (SELECT DISTINCT start, node FROM q WHERE hops > 0) JOIN o ON o.id = node GROUP BY 1)
SELECT id AS decision, coalesce(a.n, 0) AS influenced, coalesce(b.n, 0) AS precedents, round(least((coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0)) / (greatest(coalesce(a.n, 0), 1) + 0.5 * greatest(coalesce(b.n, 0), 1)), 1.0), 9) AS score FROM o LEFT JOIN a ON a.start = id LEFT JOIN b ON b.start = id""")
def _(spark, sf):
    """How many orders follow from each, how many precedents it has, and its score."""
    decisions, links = _links(spark, sf)
    return CA.impact(links, decisions).withColumn("score", F.round("score", 9))


_ARGUMENT_RULES = ["placed_in(O, N) :- ordered(O, C), lives(C, N).", "shipped_to(O, R) :- placed_in(O, N), part_of(N, R).", "urgent(O) :- priority(O, p1), open(O).", "reaches(C, R) :- lives(C, N), part_of(N, R)."]


@query("rules_arguments", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority[1:1] AS p, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'o' || k AS argument, CASE k % 3 WHEN 0 THEN r = k % 5 WHEN 1 THEN s = 'O' AND p = '1' ELSE r = k % 5 END AS valid, 1 + (s <> 'F')::BIGINT + (s = 'O')::BIGINT AS unknown_premises, 2 * (s <> 'F')::BIGINT + (s = 'O' AND p = '1')::BIGINT AS conclusions FROM o""")
def _(spark, sf):
    """Of every order an argument: that it goes to a region, is urgent, or that its customer
    reaches a region, from what is said of the order and known of customers and places."""
    o = table(spark, sf, "orders").select(node("o", "o_orderkey").alias("argument"), node("c", "o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("p"), "o_orderkey")

    def fact(pred: str, *args, when=None):
        row = F.struct(F.lit(pred).alias("pred"), F.array(*args).alias("args"))
        return row if when is None else F.when(when, row)

    said = F.array(fact("ordered", "argument", "c"), fact("priority", "argument", "p"), fact("open", "argument", when=F.col("s") == "O"))
    premises = o.select("argument", F.explode(said).alias("f")).where("f IS NOT NULL").select("argument", "f.*")
    region, k = F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string")), F.col("o_orderkey") % 3
    claim = fact("shipped_to", "argument", region, when=k == 0)
    claim = F.coalesce(claim, fact("urgent", "argument", when=k == 1), fact("reaches", "c", region))
    claims = o.select("argument", claim.alias("f")).select("argument", "f.*")
    lives = table(spark, sf, "customer").select(fact("lives", node("c", "c_custkey"), node("n", "c_nationkey")).alias("f"))
    places = table(spark, sf, "nation").select(fact("part_of", node("n", "n_nationkey"), node("r", "n_regionkey")).alias("f"))
    done = o.where("s = 'F'").select(fact("ordered", "argument", "c").alias("f"))
    return R.arguments(premises, claims, _ARGUMENT_RULES, known=lives.union(places).union(done).select("f.*"))
