"""Triples, exports, streams, and further graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.loops import Saved, components
from graphloom.operators.walks import hashed_walks
from graphloom.plans.graph import PLACES, T
from graphloom.sources import readers, writers
from graphloom.sources.tables import market_graph, node, place_graph, table
from graphloom.streaming import flows

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_TR = "t AS (SELECT 'c' || c_custkey AS s, unnest(['name', 'segment', 'type']) AS p, unnest([c_name, c_mktsegment, 'Customer']) AS o FROM customer)"


def customer_triples(spark, sf):
    return readers.triples(table(spark, sf, "customer"), subject=node("c", "c_custkey"), properties={"name": "c_name", "segment": "c_mktsegment"}, kind="Customer")


@query("triples_from_rows", f"WITH {_TR} SELECT * FROM t")
def _(spark, sf):
    return customer_triples(spark, sf)


@query("triples_to_entities", "SELECT 'c' || c_custkey AS s, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return readers.entities_from_triples(customer_triples(spark, sf), ["name", "segment"])


@query("triples_pattern", f"WITH {_TR} SELECT a.s, a.o AS name FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'name' AND b.p = 'segment' AND b.o = 'BUILDING'")
def _(spark, sf):
    t = customer_triples(spark, sf)
    return t.where("p = 'name'").select("s", F.col("o").alias("name")).join(t.where("p = 'segment' AND o = 'BUILDING'").select("s"), "s", "left_semi")


@query("export_ntriples", f"WITH {_TR} SELECT '<urn:x:' || s || '> <urn:x:' || p || '> \"' || o || '\" .' AS value FROM t")
def _(spark, sf):
    return writers.ntriples(customer_triples(spark, sf), "urn:x:")


_NODES = """pn AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier)"""


@query("export_cypher", f"""WITH {_NODES}, {PLACES} SELECT 'MERGE (n:' || upper(type[1]) || type[2:] || ' {{id: "' || id || '"}}) SET n.name = "' || name || '"' AS value FROM pn UNION ALL SELECT 'MATCH (a {{id: "' || src || '"}}), (b {{id: "' || dst || '"}}) MERGE (a)-[:' || upper(type) || ']->(b)' FROM pe""")
def _(spark, sf):
    g = place_graph(spark, sf)
    return writers.cypher(g.nodes, g.edges)


@query("export_graphml", f"""WITH {_NODES}, {PLACES} SELECT 0 AS part, '<node id="' || id || '"><data key="type">' || type || '</data></node>' AS value FROM pn UNION ALL SELECT 1, '<edge source="' || src || '" target="' || dst || '"/>' FROM pe""")
def _(spark, sf):
    g = place_graph(spark, sf)
    return writers.graphml(g.nodes, g.edges)


# ---- streams --------------------------------------------------------------------------


def _events(spark, sf):
    # a pattern, as the table may be one file or a folder of them
    return flows.event_stream(spark, f"{sf}/events*.parquet", schema=table(spark, sf, "events").schema)


@query("stream_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    out = flows.drained(flows.windowed_counts(_events(spark, sf)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sliding_counts", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1")
def _(spark, sf):
    out = flows.drained(flows.sliding_counts(_events(spark, sf), width="1 day", slide="12 hours"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, k")
def _(spark, sf):
    out = flows.drained(flows.sessions(_events(spark, sf), gap="2 hours"), "sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    return flows.drained(flows.first_seen(_events(spark, sf), "user_id", "event_type"), "first", mode="append")


@query("stream_dead_letters", "SELECT CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    good, dead = flows.parted(_events(spark, sf), "k bigint")
    kinds = good.select(F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("kind"))
    both = kinds.union(dead.select(F.lit("dead").alias("kind")))
    return flows.drained(both.groupBy("kind").agg(F.count("*").alias("n")), "dead")


# ---- further graph queries ------------------------------------------------------------


@query("graph_clique_communities", f"WITH RECURSIVE {T}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), k AS (SELECT a.src || '-' || b.src || '-' || b.dst AS tri, [a.src || '-' || b.src, a.src || '-' || b.dst, b.src || '-' || b.dst] AS sides FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src < b.src AND b.src < b.dst), s AS (SELECT tri, unnest(sides) AS side FROM k), e AS (SELECT DISTINCT a.tri AS a, b.tri AS b FROM s a JOIN s b ON a.side = b.side), r AS (SELECT a AS tri, a AS reach FROM e UNION SELECT r.tri, e.b FROM r JOIN e ON e.a = r.reach), c AS (SELECT tri, min(reach) AS community FROM r GROUP BY tri) SELECT DISTINCT community, unnest(string_split(tri, '-')) AS node FROM c")
def _(spark, sf):
    """Communities of triangles that share an edge (k-clique percolation with k = 3)."""
    saved = Saved(spark, "cliques")
    tri = G.triangle_rows(market_graph(spark, sf)).select(F.sort_array(F.array("x", "y", "z")).alias("t"))
    a, b, c = (F.col("t")[k] for k in range(3))
    named = saved.save(tri.select(F.array_join("t", "-").alias("tri"), F.explode(F.array(F.concat_ws("-", a, b), F.concat_ws("-", a, c), F.concat_ws("-", b, c))).alias("side")))
    # a side ties its triangles to the first of them: a star, not all pairs
    first = named.groupBy("side").agg(F.min("tri").alias("b"))
    grouped = components(named.join(first, "side").select(F.col("tri").alias("a"), "b"))
    all_tri = named.select("tri").distinct().join(grouped, F.col("tri") == F.col("node"), "left").select("tri", F.coalesce("component", "tri").alias("community"))
    return all_tri.select("community", F.explode(F.split("tri", "-")).alias("node")).distinct()


_walk = [f"WITH {T}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), w0 AS (SELECT DISTINCT src AS start, src AS node, src AS path FROM u)"]
for _k in range(1, 6):
    _walk.append(f"w{_k} AS MATERIALIZED (SELECT start, dst AS node, path || '>' || dst AS path FROM (SELECT start, dst, path, row_number() OVER (PARTITION BY start ORDER BY md5(start || '|{_k}|' || dst)) AS k FROM w{_k - 1} JOIN u ON u.src = w{_k - 1}.node) WHERE k = 1)")


@query("graph_random_walks", ", ".join(_walk) + " SELECT start, path FROM w5")
def _(spark, sf):
    """A seeded walk of five steps from each node: the next node is the neighbour whose hash
    with the start and the step is least."""
    return hashed_walks(market_graph(spark, sf), 5)


@query("graph_structural_similarity", f"WITH {T}, d AS (SELECT src AS node, count(*) AS k FROM t GROUP BY 1), o AS (SELECT k FROM d WHERE node = 's1') SELECT node, round(1 - abs(d.k - o.k) / greatest(d.k, o.k), 9) AS score FROM d, o WHERE node <> 's1' AND round(1 - abs(d.k - o.k) / greatest(d.k, o.k), 9) >= 0.9")
def _(spark, sf):
    """Nodes whose out-degree is near that of one node."""
    d = market_graph(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    own = d.where("node = 's1'").agg(F.max("k")).scalar()
    score = F.round(1 - F.abs(F.col("k") - own) / F.greatest(F.col("k"), own), 9)
    return d.where("node <> 's1'").select("node", score.alias("score")).where("score >= 0.9")
