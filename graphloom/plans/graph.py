"""Graph queries: the trade graph (parts and suppliers) and the place forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.loops import reachable
from graphloom.sources.tables import market_graph, place_graph, table, trade_graph

E = "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2)"
U = E + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
D = U + ", d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1)"
PLACES = """pe AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS type, 0.9::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'home_of', 0.8::DOUBLE FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'seat_of', 0.5::DOUBLE FROM supplier)"""
#: Customers, their suppliers, their nations, and back to the nations' customers.
T = """t AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""
#: Fewest hops from every nation, undirected; no node is more than HOPS away.
MOST_HOPS = 5
NEAR = f"""{T}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), n AS (SELECT DISTINCT src AS node FROM u), f AS (SELECT node FROM n WHERE node LIKE 'n%'),
w AS (SELECT node AS s, node, 0 AS h FROM f UNION SELECT s, dst, h + 1 FROM w JOIN u ON u.src = w.node WHERE h < {MOST_HOPS}),
b AS MATERIALIZED (SELECT s, node, min(h) AS h FROM w GROUP BY 1, 2)"""
Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("graph_degree_centrality", f"WITH {D} SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 9) AS centrality, rank() OVER (ORDER BY degree DESC) AS rank FROM d")
def _(spark, sf):
    return G.degree_centrality(trade_graph(spark, sf).edges).withColumn("centrality", F.round("centrality", 9))


@query("graph_connectivity_metrics", f"WITH {D} SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 9) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density FROM d")
def _(spark, sf):
    return G.connectivity_metrics(trade_graph(spark, sf).edges).withColumn("avg_degree", F.round("avg_degree", 9)).withColumn("density", F.round("density", 9))


@query("graph_type_distribution", f"WITH {PLACES} SELECT 'node' AS kind, 'region' AS type, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'edge', type, count(*) FROM pe GROUP BY type")
def _(spark, sf):
    g = place_graph(spark, sf)
    return G.type_distribution(g.nodes, g.edges)


@query("graph_directed_density", f"WITH {PLACES}, n AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS k) SELECT count(*) AS edges, any_value(k) AS nodes, round(count(*) / (any_value(k) * (any_value(k) - 1)), 12) AS density FROM pe, n")
def _(spark, sf):
    g = place_graph(spark, sf)
    return G.directed_density(g.nodes, g.edges).withColumn("density", F.round("density", 12))


for way, ends in (("out", "SELECT src AS id FROM e"), ("in", "SELECT dst AS id FROM e"), ("both", "SELECT src AS id FROM e UNION ALL SELECT dst FROM e")):
    S[f"graph_store_degree_{way}"] = f"WITH {E}, k AS ({ends}), n AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier) SELECT n.id, count(k.id) AS degree FROM n LEFT JOIN k ON n.id = k.id GROUP BY n.id"

    def _degree(spark, sf, way=way):
        g = trade_graph(spark, sf)
        return G.directed_degree(g.nodes, g.edges, way)

    Q[f"graph_store_degree_{way}"] = _degree

HOPS = f"""WITH RECURSIVE {PLACES}, walk AS (
  SELECT 'r0' AS node, 0 AS hop, 1.0::DOUBLE AS decay
  UNION ALL SELECT pe.dst, hop + 1, decay * weight FROM walk JOIN pe ON pe.src = walk.node WHERE hop < 2)
SELECT node, hop, round(decay, 9) AS decay, CASE WHEN hop <= 1 THEN 'direct' WHEN hop <= 3 THEN 'near' WHEN hop <= 6 THEN 'mid-range' ELSE 'distant' END AS band FROM walk WHERE hop > 0"""


@query("graph_neighbors_khop", HOPS)
def _(spark, sf):
    return G.neighbors(place_graph(spark, sf).edges, "r0", 2).withColumn("decay", F.round("decay", 9))


@query("graph_neighbors_typed", f"WITH {PLACES} SELECT b.dst AS node, 2 AS hop, round(a.weight * b.weight, 9) AS decay, 'near' AS band FROM pe a JOIN pe b ON a.dst = b.src WHERE a.src = 'r1' AND b.type = 'home_of' UNION ALL SELECT dst, 1, weight, 'direct' FROM pe WHERE src = 'r1'")
def _(spark, sf):
    return G.neighbors(place_graph(spark, sf).edges, "r1", 2, types=["contains", "home_of"], min_weight=0.6).withColumn("decay", F.round("decay", 9))


@query("graph_connected_components", f"WITH {PLACES}, tree AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id FROM region UNION ALL SELECT src, dst FROM pe WHERE type = 'contains' UNION ALL SELECT a.src, b.dst FROM pe a JOIN pe b ON a.dst = b.src WHERE a.type = 'contains') SELECT id, min(id) OVER (PARTITION BY root) AS component FROM tree")
def _(spark, sf):
    g = place_graph(spark, sf)
    return G.connected(g.nodes, g.edges)


@query("graph_component_sizes", f"WITH {PLACES}, tree AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id FROM region UNION ALL SELECT src, dst FROM pe WHERE type = 'contains' UNION ALL SELECT a.src, b.dst FROM pe a JOIN pe b ON a.dst = b.src WHERE a.type = 'contains') SELECT min(id) AS component, count(*) AS size FROM tree GROUP BY root")
def _(spark, sf):
    g = place_graph(spark, sf)
    return G.connected(g.nodes, g.edges).groupBy("component").agg(F.count("*").alias("size"))


_pr = [f"WITH {D}, n AS (SELECT count(*) AS n FROM d), r0 AS (SELECT node, 1.0 / n AS score FROM d, n)"]
for _k in range(1, 21):
    _pr.append(f"r{_k} AS MATERIALIZED (SELECT u.dst AS node, 0.15 / any_value(n.n) + 0.85 * sum(r.score / d.degree) AS score FROM u JOIN r{_k - 1} r ON r.node = u.src JOIN d ON d.node = u.src, n GROUP BY u.dst)")


@query("graph_pagerank", ", ".join(_pr) + " SELECT node, round(score, 10) AS score FROM r20")
def _(spark, sf):
    return G.pagerank(trade_graph(spark, sf).edges).withColumn("score", F.round("score", 10))


_ev = [f"WITH {D}, x0 AS (SELECT node, 1.0::DOUBLE AS score FROM d)"]
for _k in range(1, 21):
    _ev.append(f"y{_k} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (SELECT u.dst AS node, score FROM u JOIN x{_k - 1} x ON x.node = u.src UNION ALL SELECT node, score FROM x{_k - 1}) GROUP BY node), x{_k} AS MATERIALIZED (SELECT node, score / (SELECT sqrt(sum(score * score)) FROM y{_k}) AS score FROM y{_k})")


@query("graph_eigenvector_centrality", ", ".join(_ev) + " SELECT node, round(score, 9) AS score FROM x20")
def _(spark, sf):
    return G.eigenvector(trade_graph(spark, sf).edges).withColumn("score", F.round("score", 9))


@query("graph_link_scores", f"""WITH {D}, c AS (
  SELECT a.src AS u, b.src AS v, count(*) AS cn, sum(CASE WHEN z.degree > 1 THEN 1 / (z.degree * ln(z.degree)) ELSE 0 END) AS aa, sum(1 / z.degree) AS ra
  FROM u a JOIN u b ON a.dst = b.dst AND a.src < b.src JOIN d z ON z.node = a.dst WHERE a.src LIKE 's%' AND b.src LIKE 's%' GROUP BY 1, 2)
SELECT c.u, c.v, cn AS common_neighbors, round(cn / (x.degree + y.degree - cn), 9) AS jaccard, round(aa, 9) AS adamic_adar, round(ra, 9) AS resource_allocation, x.degree * y.degree AS preferential_attachment
FROM c JOIN d x ON x.node = c.u JOIN d y ON y.node = c.v""")
def _(spark, sf):
    # links are predicted between suppliers, from the parts that two of them deliver
    scores = G.link_scores(trade_graph(spark, sf).edges, among=F.col("src").startswith("s"))
    return scores.select("u", "v", "common_neighbors", *[F.round(c, 9).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")], "preferential_attachment")


def _nation_nodes(edges):
    return G.adjacency(edges).select(F.col("src").alias("id")).distinct().where("id LIKE 'n%'")


@query("graph_closeness_centrality", f"""WITH RECURSIVE {NEAR}
SELECT s AS id, round((count(*) / sum(h)) * (count(*) / ((SELECT count(*) FROM n) - 1)), 9) AS closeness FROM b WHERE h > 0 GROUP BY s""")
def _(spark, sf):
    """Closeness of the nations among all customers, suppliers and nations."""
    edges = market_graph(spark, sf)
    return G.closeness(edges, _nation_nodes(edges)).withColumn("closeness", F.round("closeness", 9))


@query("graph_bfs_distances", f"""WITH RECURSIVE {T}, w AS (SELECT 'n0' AS node, 0 AS h UNION SELECT dst, h + 1 FROM w JOIN t ON t.src = w.node WHERE h < 8)
SELECT 'n0' AS start, node, min(h) AS hops FROM w GROUP BY node""")
def _(spark, sf):
    return reachable(market_graph(spark, sf), spark.range(1).select(F.lit("n0").alias("start")))


_bt = [f"WITH RECURSIVE {NEAR}, p0 AS (SELECT node AS s, node, 1.0::DOUBLE AS paths FROM f)"]
for _k in range(1, MOST_HOPS + 1):
    _bt.append(f"p{_k} AS MATERIALIZED (SELECT p.s, u.dst AS node, sum(p.paths) AS paths FROM p{_k - 1} p JOIN u ON u.src = p.node JOIN b ON b.s = p.s AND b.node = u.dst AND b.h = {_k} GROUP BY 1, 2)")
_bt.append(f"d{MOST_HOPS} AS (SELECT s, node, paths, 0.0::DOUBLE AS share FROM p{MOST_HOPS})")
for _k in range(MOST_HOPS - 1, 0, -1):
    _bt.append(f"d{_k} AS MATERIALIZED (SELECT p.s, p.node, p.paths, coalesce(sum((1 + d.share) / d.paths * p.paths), 0) AS share FROM p{_k} p LEFT JOIN (SELECT d.*, u.dst AS up FROM d{_k + 1} d JOIN u ON u.src = d.node) d ON d.s = p.s AND d.up = p.node GROUP BY 1, 2, 3)")
_bt.append("a AS (SELECT node, 0.0 AS share FROM n UNION ALL " + " UNION ALL ".join(f"SELECT node, share FROM d{_k}" for _k in range(1, MOST_HOPS + 1)) + ")")


@query("graph_betweenness_centrality", ", ".join(_bt) + " SELECT node, round(sum(share) / ((SELECT count(*) FROM f) * ((SELECT count(*) FROM n) - 1)), 9) AS betweenness FROM a GROUP BY node")
def _(spark, sf):
    """Shares of the shortest paths that start at nations."""
    edges = market_graph(spark, sf)
    return G.betweenness(edges, sources=_nation_nodes(edges)).withColumn("betweenness", F.round("betweenness", 9))


@query("graph_triangles", f"WITH {T}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), r AS (SELECT a.src AS x, b.src AS y, b.dst AS z FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src < b.src AND b.src < b.dst) SELECT node, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM r) GROUP BY node")
def _(spark, sf):
    return G.triangles(market_graph(spark, sf))


_lp = [f"WITH {T}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), l0 AS (SELECT DISTINCT src AS node, src AS label FROM u)"]
for _k in range(1, 6):
    _lp.append(f"l{_k} AS MATERIALIZED (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM u JOIN l{_k - 1} ON u.dst = l{_k - 1}.node GROUP BY src, label) WHERE k = 1)")


@query("graph_label_propagation", ", ".join(_lp) + " SELECT node, label AS community FROM l5")
def _(spark, sf):
    return G.label_propagation(market_graph(spark, sf))


@query("graph_community_metrics", f"WITH {PLACES}, m AS (SELECT id, root FROM (SELECT src AS root, dst AS id FROM pe WHERE type = 'contains' UNION ALL SELECT src, src FROM pe WHERE type = 'contains' GROUP BY src UNION ALL SELECT src, dst FROM pe WHERE type <> 'contains')), s AS (SELECT root, count(*) AS n FROM m GROUP BY root), w AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe), k AS (SELECT a.root AS ra, b.root AS rb FROM w JOIN m a ON a.id = w.src JOIN m b ON b.id = w.dst) SELECT count(*) AS communities, max(n) AS largest, round(avg(n), 9) AS avg_size, (SELECT count(*) FROM k WHERE ra = rb) AS intra, (SELECT count(*) FROM k WHERE ra <> rb) AS inter, round((SELECT count(*) FROM k WHERE ra = rb) / ((SELECT count(*) FROM k WHERE ra <> rb) + 1), 9) AS edge_ratio FROM s")
def _(spark, sf):
    # communities by parent: a nation is in its region's, a customer or supplier in its nation's
    edges = place_graph(spark, sf).edges
    mine = edges.select(F.col("dst").alias("node"), F.col("src").alias("community"))
    roots = edges.where("type = 'contains'").select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    return G.community_metrics(edges, mine.union(roots)).withColumn("avg_size", F.round("avg_size", 9)).withColumn("edge_ratio", F.round("edge_ratio", 9))


@query("graph_weighted_distances", f"WITH RECURSIVE {PLACES}, w AS (SELECT 'r2' AS node, 0.0::DOUBLE AS distance UNION ALL SELECT pe.dst, distance + weight FROM w JOIN pe ON pe.src = w.node) SELECT node, round(min(distance), 9) AS distance FROM w GROUP BY node")
def _(spark, sf):
    return G.shortest_weighted(place_graph(spark, sf).edges, "r2").withColumn("distance", F.round("distance", 9))


@query("graph_k_shortest_paths", f"WITH RECURSIVE {T}, w AS (SELECT ['n0'] AS path UNION ALL SELECT list_append(path, dst) FROM w JOIN t ON t.src = path[len(path)] WHERE len(path) <= 2 AND NOT list_contains(path, dst) AND path[len(path)] <> 's7') SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, CAST(len(path) - 1 AS DOUBLE) AS cost FROM w WHERE path[len(path)] = 's7' ORDER BY cost, path LIMIT 10")
def _(spark, sf):
    return G.paths(market_graph(spark, sf).withColumn("weight", F.lit(1.0)), "n0", "s7", max_hops=2, k=10)


@query("graph_cycles", f"WITH {T} SELECT a.src || '>' || a.dst AS cycle, 2 AS length FROM t a JOIN t b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '>' || b.src || '>' || c.src, 3 FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src")
def _(spark, sf):
    return G.cycles(market_graph(spark, sf), max_length=3)


@query("graph_bridges", f"WITH {PLACES} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM pe")
def _(spark, sf):
    return G.bridges(place_graph(spark, sf).edges)


@query("graph_structure", f"WITH {PLACES}, u AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe), d AS (SELECT src, count(*) AS k FROM u GROUP BY src) SELECT count(*) AS nodes, CAST(sum(k) / 2 AS BIGINT) AS edges, round(sum(k) / (count(*) * (count(*) - 1)), 9) AS density, 'disconnected' AS structure FROM d")
def _(spark, sf):
    g = place_graph(spark, sf)
    n = G.connected(g.nodes, g.edges).select("component").distinct().count()
    return G.structure(g.edges, n).select("nodes", "edges", F.round("density", 9).alias("density"), "structure")


@query("graph_dangling_edges", "SELECT DISTINCT 'o' || l_orderkey AS missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def _(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("missing")).distinct()
