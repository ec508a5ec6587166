"""Proofs, paths, parsers, exports, ontologies, stores and decisions: queries and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import ontology as O
from graphloom.operators import rules as R
from graphloom.operators import stores as ST
from graphloom.operators import temporal as T
from graphloom.operators import versions as V
from graphloom.plans.exchange import _NODES
from graphloom.plans.graph import PLACES
from graphloom.plans.graph import T as MARKET
from graphloom.sources import writers as W
from graphloom.sources.tables import market_graph, node, place_graph, table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


# ---- proofs -----------------------------------------------------------------------------

_RULES = ["within(X, Y) :- part_of(X, Y).", "within(X, Z) :- part_of(X, Y), within(Y, Z).", "rich(X) :- balance_over(X, K)."]
_LEAVES = "SELECT 's' || s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer"


def _place_facts(spark, sf):
    return place_graph(spark, sf).edges.select(F.lit("part_of").alias("pred"), F.array("dst", "src").alias("args"))


@query("rules_backward_proofs", f"WITH e AS ({_LEAVES}) SELECT id AS x, 2 AS depth, 1 AS rule FROM e JOIN nation ON n_nationkey = k WHERE n_regionkey = 2 UNION ALL SELECT 'n' || n_nationkey, 1, 0 FROM nation WHERE n_regionkey = 2")
def _(spark, sf):
    """What can be proved to lie in one region, how deep, and by which rule."""
    return R.proofs(_place_facts(spark, sf), _RULES, "within(X, r2)", max_depth=10).select(F.col("args")[0].alias("x"), "depth", "rule")


@query("rules_explanations", f"WITH e AS ({_LEAVES}) SELECT 'within(' || id || ', r2) follows at depth 2 by within(X, Z) :- part_of(X, Y), within(Y, Z).' AS explanation FROM e JOIN nation ON n_nationkey = k WHERE n_regionkey = 2 UNION ALL SELECT 'within(n' || n_nationkey || ', r2) follows at depth 1 by within(X, Y) :- part_of(X, Y).' FROM nation WHERE n_regionkey = 2")
def _(spark, sf):
    return R.proofs(_place_facts(spark, sf), _RULES, "within(X, r2)").select(R.explained(_RULES).alias("explanation"))


_CAUSES = ["late(X) :- storm(Y), route(X, Y).", "late(X) :- strike(X).", "late(X) :- ordered(X), stocked(X), lost(X)."]


@query("rules_hypotheses", "WITH o AS (SELECT DISTINCT 'o' || l_orderkey AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 100 DAY), r(rule, score) AS (VALUES (0, round(0.4 * 0.5 + 0.15 + 0.3 / 3, 9)), (1, round(0.4 * 0.9 + 0.15 + 0.3 / 2, 9)), (2, round(0.4 * 0.7 + 0.15 + 0.3 / 4, 9))) SELECT x, rule, score, CAST(row_number() OVER (PARTITION BY x ORDER BY score DESC, rule) AS INTEGER) AS rank FROM o, r")
def _(spark, sf):
    """Why orders may be late: rules whose heads unify, ranked."""
    late = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate > o_orderdate + INTERVAL 100 DAYS")
    observed = late.select(F.lit("late").alias("pred"), F.array(node("o", "l_orderkey")).alias("args")).distinct()
    return R.hypotheses(observed, _CAUSES, [0.5, 0.9, 0.7]).select(F.col("args")[0].alias("x"), "rule", F.round("score", 9).alias("score"), "rank")


# ---- time -------------------------------------------------------------------------------

_TRADE = """e AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, l_shipdate, l_shipdate + INTERVAL 30 DAY FROM lineitem)"""


def _trade(spark, sf):
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(node("c", "o_custkey").alias("src"), node("s", "l_suppkey").alias("dst"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("end"))
    return bought.union(items.select(node("s", "l_suppkey"), node("p", "l_partkey"), "l_shipdate", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")))


for _way, _rule in (("strict", "b.s >= a.s"), ("overlap", "b.s <= a.e"), ("loose", "true")):
    S[f"temporal_paths_{_way}"] = f"WITH {_TRADE}, w AS (SELECT * FROM e WHERE s <= TIMESTAMP '1998-12-31' AND e >= TIMESTAMP '1997-01-01') SELECT 'c7>' || a.dst || '>p11' AS path, count(*) AS ways FROM w a JOIN w b ON a.dst = b.src WHERE a.src = 'c7' AND b.dst = 'p11' AND {_rule} GROUP BY 1"

    def _paths(spark, sf, way=_way):
        """From a customer to a part, each step in its order of time."""
        low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1998-12-31"))
        return T.paths(_trade(spark, sf), "c7", "p11", low=low, high=high, max_nodes=3, ordering=way)

    Q[f"temporal_paths_{_way}"] = _paths


@query("temporal_phrases", """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS t FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 0 THEN t - 1 WHEN 1 THEN date_trunc('month', t) - INTERVAL 1 MONTH WHEN 2 THEN date_trunc('quarter', t) WHEN 3 THEN date_trunc('year', t) - INTERVAL 1 YEAR WHEN 4 THEN date_trunc('month', t - INTERVAL 3 MONTH) ELSE date_trunc('week', t) - INTERVAL 7 DAY END AS DATE)::VARCHAR AS start,
CAST(CASE k WHEN 0 THEN t WHEN 1 THEN date_trunc('month', t) WHEN 2 THEN date_trunc('quarter', t) + INTERVAL 3 MONTH WHEN 3 THEN date_trunc('year', t) WHEN 4 THEN date_trunc('month', t - INTERVAL 3 MONTH) + INTERVAL 1 MONTH ELSE date_trunc('week', t) END AS DATE)::VARCHAR AS stop FROM d""")
def _(spark, sf):
    """Relative phrases seen from each order's day."""
    said = F.element_at(F.array(*[F.lit(p) for p in ("yesterday", "Last month", "this quarter", "last year", "3 months ago", "last week")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    p = T.phrase(said, F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", p["start"].cast("string").alias("start"), p["end"].cast("string").alias("stop"))


@query("temporal_questions", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'at' END AS intent, strftime(o_orderdate, '%Y-%m-%d') AS moment, 'Which orders did c' || o_custkey || ' place?' AS question FROM orders")
def _(spark, sf):
    word = F.element_at(F.array(F.lit("before"), F.lit("after"), F.lit("on")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    asked = F.concat(F.lit("Which orders did "), node("c", "o_custkey"), F.lit(" place "), word, F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("?"))
    return table(spark, sf, "orders").select("o_orderkey", X.rewritten_question(asked).alias("q")).select("o_orderkey", "q.*")


# ---- graphs -----------------------------------------------------------------------------


@query("graph_path_rows", f"WITH RECURSIVE {PLACES}, w AS (SELECT 'r2' AS node, 0.0::DOUBLE AS distance, 'r2' AS path UNION ALL SELECT pe.dst, distance + weight, path || '>' || pe.dst FROM w JOIN pe ON pe.src = w.node) SELECT node, round(distance, 9) AS distance, path FROM w")
def _(spark, sf):
    return G.path_rows(place_graph(spark, sf).edges, "r2").withColumn("distance", F.round("distance", 9))


@query("graph_linked_path", f"WITH RECURSIVE {PLACES}, {MARKET}, l AS (SELECT 'market:' || src AS src, 'market:' || dst AS dst FROM t UNION ALL SELECT 'place:' || src, 'place:' || dst FROM pe UNION ALL SELECT 'place:n' || n_nationkey, 'market:n' || n_nationkey FROM nation), w AS (SELECT 'place:r1' AS node, 0 AS hops UNION SELECT l.dst, hops + 1 FROM w JOIN l ON l.src = w.node WHERE hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY node")
def _(spark, sf):
    """Three hops from a region through links between two graphs."""
    from graphloom.operators.loops import reachable

    links = table(spark, sf, "nation").select(F.lit("place").alias("source_graph"), node("n", "n_nationkey").alias("source"), F.lit("market").alias("target_graph"), node("n", "n_nationkey").alias("target"))
    edges = G.linked_graphs({"market": market_graph(spark, sf), "place": place_graph(spark, sf).edges}, links)
    return reachable(edges, spark.range(1).select(F.lit("place:r1").alias("start")), max_hops=3).select("node", "hops")


@query("graph_distances", f"WITH RECURSIVE {MARKET}, f AS (SELECT 'n' || n_nationkey AS id FROM nation), w AS (SELECT id AS a, id AS node, 0 AS hops FROM f UNION SELECT a, t.dst, hops + 1 FROM w JOIN t ON t.src = w.node WHERE hops < 3), d AS (SELECT a, node AS b, min(hops) AS hops FROM w WHERE node IN (SELECT id FROM f) GROUP BY 1, 2) SELECT a, b, hops, 'near' AS band, round(1 / hops, 9) AS proximity FROM d WHERE hops > 0")
def _(spark, sf):
    """Distances between nations over customers and suppliers."""
    nations = table(spark, sf, "nation").select(node("n", "n_nationkey").alias("id"))
    return G.distances(market_graph(spark, sf), nations, max_hops=3).withColumn("proximity", F.round("proximity", 9))


@query("graph_network_metrics", f"WITH {MARKET}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM t UNION ALL SELECT dst FROM t) GROUP BY 1), m AS (SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, max(d) AS max_degree FROM d) SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density, round(least((nodes * (nodes - 1)) / edges, nodes), 9) AS mean_path, max_degree, 1 AS components FROM m")
def _(spark, sf):
    m = G.network_metrics(market_graph(spark, sf))
    return m.withColumn("density", F.round("density", 9)).withColumn("mean_path", F.round("mean_path", 9))


@query("graph_modularity", f"WITH {PLACES}, u AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe), c AS (SELECT dst AS node, CASE WHEN type = 'contains' THEN dst ELSE src END AS community FROM pe UNION SELECT src, src FROM pe WHERE type = 'contains'), d AS (SELECT src AS node, count(*) AS d FROM u GROUP BY 1), m AS (SELECT count(*) AS m FROM u), t AS (SELECT community, sum(d) AS total FROM d JOIN c USING (node) GROUP BY 1), i AS (SELECT a.community, count(*) AS n FROM u JOIN c a ON a.node = u.src JOIN c b ON b.node = u.dst WHERE a.community = b.community GROUP BY 1) SELECT count(*) AS communities, round(sum(coalesce(n, 0) / m - (total / m) * (total / m)), 9) AS modularity FROM t LEFT JOIN i USING (community), m")
def _(spark, sf):
    """Of a partition of the place forest by nations."""
    edges = place_graph(spark, sf).edges
    mine = edges.select(F.col("dst").alias("node"), F.when(F.col("type") == "contains", F.col("dst")).otherwise(F.col("src")).alias("community"))
    roots = edges.where("type = 'contains'").select(F.col("src").alias("node"), F.col("src").alias("community"))
    return G.modularity(edges, mine.union(roots).distinct()).withColumn("modularity", F.round("modularity", 9))


@query("graph_modular_communities")
def _(spark, sf):
    return G.modular_communities(place_graph(spark, sf).edges, rounds=5)


# ---- parsers, over documents that tell rows of the tables ---------------------------------


@query("xml_values", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(2 AS INTEGER) AS fields FROM customer")
def _(spark, sf):
    doc = F.concat(F.lit("<customer><field key='name'>"), "c_name", F.lit("</field><field key='segment'>"), "c_mktsegment", F.lit("</field></customer>"))
    rows = table(spark, sf, "customer").select("c_custkey", doc.alias("x"))
    return rows.select("c_custkey", F.xpath_string("x", F.lit("customer/field[@key='name']")).alias("name"), F.xpath_string("x", F.lit("customer/field[@key='segment']")).alias("segment"), F.size(F.xpath("x", F.lit("customer/field/text()"))).alias("fields"))


@query("mail_threads", "SELECT 'order ' || o_custkey % 40 AS thread, count(*) AS messages, count(DISTINCT 'c' || o_custkey || '@example.org') AS senders, min(o_orderkey) AS first FROM orders GROUP BY 1")
def _(spark, sf):
    subject = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Re: ")).otherwise(F.lit("FWD: re: ")), F.lit("Order "), (F.col("o_custkey") % 40).cast("string"))
    message = F.concat(F.lit("From: "), node("c", "o_custkey"), F.lit("@example.org\r\nTo: shop@example.org\r\nSubject: "), subject, F.lit("\r\nX-Long: a\r\n b\r\n\r\nOrder "), F.col("o_orderkey").cast("string"), F.lit(".\r\n"))
    m = table(spark, sf, "orders").select("o_orderkey", X.mail(message).alias("m"))
    return m.groupBy("m.thread").agg(F.count("*").alias("messages"), F.countDistinct("m.sender").alias("senders"), F.min("o_orderkey").alias("first"))


@query("code_outline", "SELECT s_suppkey, 'load_' || s_suppkey || ',close' AS functions, 'Store' || s_nationkey AS classes, 'os.path,typing' AS imports, CAST(1 AS INTEGER) AS comments FROM supplier")
def _(spark, sf):
    code = F.concat(F.lit("import os.path\nfrom typing import Any\n\n\nclass Store"), F.col("s_nationkey").cast("string"), F.lit(":\n    async def load_"), F.col("s_suppkey").cast("string"), F.lit("(self):\n        pass  # later\n\n\ndef close():\n    return None\n"))
    c = X.code_structure(code)
    return table(spark, sf, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", *[F.array_join(f"c.{n}", ",").alias(n) for n in ("functions", "classes", "imports")], F.size("c.comments").alias("comments"))


@query("json_schemas", "SELECT 'k BIGINT' AS shape, count(*) AS n FROM events")
def _(spark, sf):
    """Shapes of the events' documents: names and types of their fields."""
    v = F.parse_json("props")
    shape = F.regexp_replace(F.regexp_replace(F.schema_of_variant(v), "^OBJECT<|>$", ""), ": ", " ")
    return table(spark, sf, "events").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


# ---- exports ----------------------------------------------------------------------------


def _supplier_triples(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(node("s", "s_suppkey").alias("s"), F.explode(F.array(F.struct(F.lit("name").alias("p"), F.col("s_name").alias("o")), F.struct(F.lit("nation").alias("p"), F.col("s_nationkey").cast("string").alias("o")))).alias("x")).select("s", "x.p", "x.o")


@query("export_turtle", """SELECT '<urn:x:s' || s_suppkey || '> <urn:x:name> "' || s_name || '" ; <urn:x:nation> "' || s_nationkey || '" .' AS value FROM supplier""")
def _(spark, sf):
    return W.turtle(_supplier_triples(spark, sf), "urn:x:")


@query("export_json_ld", """SELECT '{"@id":"urn:x:' || c_custkey || '","@type":"Customer","c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer""")
def _(spark, sf):
    return W.json_ld(table(spark, sf, "customer").withColumn("key", F.col("c_custkey").cast("string")), "key", "Customer", ["c_name", "c_mktsegment"], "urn:x:")


@query("export_rdf_xml", """SELECT '<rdf:Description rdf:about="urn:x:p' || p_partkey || '"><x:p_name>' || p_name || '</x:p_name><x:p_size>' || p_size || '</x:p_size></rdf:Description>' AS value FROM part""")
def _(spark, sf):
    return W.rdf_xml(table(spark, sf, "part").withColumn("id", node("p", "p_partkey")), "id", ["p_name", "p_size"], "urn:x:")


@query("export_yaml", """SELECT '- id: "' || p_partkey || '"' || chr(10) || '  p_brand: "' || p_brand || '"' || chr(10) || '  p_size: "' || p_size || '"' AS value FROM part""")
def _(spark, sf):
    return W.yaml(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"])


@query("export_aql", f"""WITH {_NODES}, {PLACES} SELECT 'INSERT {{"_key":"' || id || '","type":"' || type || '","name":"' || name || '"}} INTO nodes' AS value FROM pn UNION ALL SELECT 'INSERT {{"_from":"nodes/' || src || '","_to":"nodes/' || dst || '","type":"' || type || '"}} INTO edges' FROM pe""")
def _(spark, sf):
    g = place_graph(spark, sf)
    return W.aql(g.nodes, g.edges)


@query("export_owl_classes", "SELECT DISTINCT '<urn:o:' || upper(p_type[1]) || lower(p_type[2:]) || '> a owl:Class ; rdfs:subClassOf <urn:o:Part> .' AS value FROM part UNION ALL SELECT '<urn:o:Part> a owl:Class .' UNION ALL SELECT DISTINCT '<urn:o:has' || p_brand || '> a owl:ObjectProperty ; rdfs:domain <urn:o:Part> ; rdfs:range <urn:o:Brand> .' FROM part")
def _(spark, sf):
    kinds = table(spark, sf, "part").select(F.initcap(F.lower("p_type")).alias("name")).distinct()
    classes = kinds.select(W.owl_class(F.col("name"), F.lit("Part"), "urn:o:").alias("value"))
    top = spark.range(1).select(W.owl_class(F.lit("Part"), F.lit(None).cast("string"), "urn:o:").alias("value"))
    brands = table(spark, sf, "part").select("p_brand").distinct().select(W.owl_property(F.concat(F.lit("has"), "p_brand"), "ObjectProperty", F.lit("Part"), F.lit("urn:o:Brand"), "urn:o:").alias("value"))
    return classes.union(top).union(brands)


@query("export_shacl_shapes", "SELECT DISTINCT '<urn:o:' || p_type || 'Shape> a sh:NodeShape ; sh:targetClass <urn:o:' || p_type || '> ; sh:property [ sh:path <urn:o:p_name> ; sh:datatype xsd:string ; sh:minCount 1 ] ; sh:property [ sh:path <urn:o:p_size> ; sh:datatype xsd:integer ] .' AS value FROM part")
def _(spark, sf):
    kinds = table(spark, sf, "part").select("p_type").distinct()
    return kinds.select(W.shacl_shape(F.col("p_type"), [("p_name", "string", 1), ("p_size", "integer", 0)], "urn:o:").alias("value"))


@query("export_concepts", "SELECT s, p, o FROM (SELECT 'n' || n_nationkey AS c, n_name AS l, 'r' || n_regionkey AS b, n_nationkey::VARCHAR AS n FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, s_suppkey::VARCHAR FROM supplier) x, LATERAL (SELECT unnest([c, c, c, c, b, c]) AS s, unnest(['rdf:type', 'skos:inScheme', 'skos:prefLabel', 'skos:broader', 'skos:narrower', 'skos:notation']) AS p, unnest(['skos:Concept', 'places', l, b, c, n]) AS o)")
def _(spark, sf):
    n = table(spark, sf, "nation").select(node("n", "n_nationkey").alias("concept"), F.col("n_name").alias("label"), node("r", "n_regionkey").alias("broader"), F.col("n_nationkey").cast("string").alias("notation"))
    s = table(spark, sf, "supplier").select(node("s", "s_suppkey"), "s_name", node("n", "s_nationkey"), F.col("s_suppkey").cast("string"))
    return O.concept_triples(n.union(s), "places")


# ---- ontologies -------------------------------------------------------------------------


@query("ontology_coverage", "WITH n AS (SELECT DISTINCT p_type AS term FROM part UNION SELECT DISTINCT o_orderpriority FROM orders), k AS (SELECT DISTINCT p_type AS term FROM part WHERE p_size > 10) SELECT count(*) AS terms, count(k.term) AS answerable, round(count(k.term) / count(*), 9) AS coverage, array_to_string(list_sort(list(n.term) FILTER (k.term IS NULL)), ',') AS gaps FROM n LEFT JOIN k ON n.term = k.term")
def _(spark, sf):
    part = table(spark, sf, "part")
    needed = part.select(F.col("p_type").alias("term")).union(table(spark, sf, "orders").select("o_orderpriority"))
    return O.coverage(needed, part.where("p_size > 10").select(F.col("p_type").alias("term"))).withColumn("coverage", F.round("coverage", 9))


@query("ontology_granularity", "WITH n AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS class, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT class, n, n / (SELECT sum(n) FROM n) AS share FROM n) SELECT class, n, round(share, 9) AS share, CASE WHEN share > 0.5 THEN 'coarse' WHEN share < 0.05 THEN 'fine' ELSE 'balanced' END AS level FROM s")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderpriority")).alias("class"))
    return O.granularity(o).withColumn("share", F.round("share", 9))


@query("ontology_names", "SELECT DISTINCT p_name, 'https://example.org/onto/' || list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || b) AS iri, true AS valid FROM part")
def _(spark, sf):
    iri = O.class_iri(F.col("p_name"), "https://example.org/onto/")
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", iri.alias("iri"), O.valid_iri(iri).alias("valid"))


@query("ontology_alignment_scores", "WITH a AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS t FROM part UNION SELECT lower(p_type) FROM part), b AS (SELECT lower(p_brand) AS t FROM part UNION SELECT lower(p_type) FROM part) SELECT count(a.t) AS left_terms, count(b.t) AS right_terms, count(CASE WHEN a.t = b.t THEN 1 END) AS shared, round(count(CASE WHEN a.t = b.t THEN 1 END) / count(*), 9) AS overlap, round(count(CASE WHEN a.t = b.t THEN 1 END) / count(a.t), 9) AS covered FROM a FULL JOIN b ON a.t = b.t")
def _(spark, sf):
    part = table(spark, sf, "part")
    words = F.explode(F.split("p_name", " ")).alias("term")
    scores = O.alignment_scores(part.select(words).union(part.select("p_type")), part.select(F.col("p_brand").alias("term")).union(part.select("p_type")))
    return scores.withColumn("overlap", F.round("overlap", 9)).withColumn("covered", F.round("covered", 9))


@query("ontology_violations", "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand END AS p_brand, p_type, p_size FROM part) SELECT p_partkey, 'p_brand' AS path, 'minCount' AS constraint, NULL AS value FROM p WHERE p_brand IS NULL UNION ALL SELECT p_partkey, 'p_brand', 'pattern', p_brand FROM p WHERE p_brand IS NOT NULL AND NOT regexp_full_match(p_brand, 'Brand#1[0-9]*') UNION ALL SELECT p_partkey, 'p_type', 'in', p_type FROM p WHERE p_type NOT IN ('PROMO', 'STANDARD') UNION ALL SELECT p_partkey, 'p_size', 'maxInclusive', p_size::VARCHAR FROM p WHERE p_size > 40")
def _(spark, sf):
    rows = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") > 5, F.col("p_brand")))
    return O.shape_violations(rows, "p_partkey", [{"path": "p_brand", "min_count": 1, "pattern": "^Brand#1[0-9]*$"}, {"path": "p_type", "in": ["PROMO", "STANDARD"]}, {"path": "p_size", "datatype": "int", "max": 40}])


@query("ontology_associations", "SELECT 'Delivery-' || l_orderkey || '-' || l_suppkey || '-' || l_linenumber AS s, p, o FROM lineitem, LATERAL (SELECT unnest(['rdf:type', 'hasOrder', 'hasSupplier', 'hasLine', 'l_returnflag']) AS p, unnest(['Delivery', l_orderkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag]) AS o)")
def _(spark, sf):
    return O.associations(table(spark, sf, "lineitem"), "Delivery", {"Order": "l_orderkey", "Supplier": "l_suppkey", "Line": "l_linenumber"}, ["l_returnflag"])


@query("ontology_imports", "WITH RECURSIVE i AS (SELECT DISTINCT 'm' || p_partkey AS a, 'm' || p_partkey // 3 AS b FROM part WHERE p_partkey > 0), w AS (SELECT a AS module, b AS needs FROM i UNION SELECT module, b FROM w JOIN i ON i.a = w.needs) SELECT module, count(*) AS imports FROM w GROUP BY module")
def _(spark, sf):
    """How many modules each module needs, directly or not."""
    from graphloom.operators.loops import reachable

    p = table(spark, sf, "part").where("p_partkey > 0")
    imports = p.select(node("m", "p_partkey").alias("src"), F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("dst"))
    walk = reachable(imports, imports.select(F.col("src").alias("start")))
    return walk.where("hops > 0").groupBy(F.col("start").alias("module")).agg(F.count("*").alias("imports"))


@query("ontology_expanded", "WITH a AS (SELECT 'p' || p_partkey AS x, 'q' || p_partkey % 50 AS y, CASE WHEN p_size > 20 THEN 'owl:sameAs' ELSE 'skos:exactMatch' END AS p FROM part) SELECT DISTINCT x AS entity, y AS match FROM a WHERE p = 'owl:sameAs' UNION SELECT y, x FROM a WHERE p = 'owl:sameAs'")
def _(spark, sf):
    """Aligned entities in both directions, over the predicates that align."""
    p = F.when(F.col("p_size") > 20, "owl:sameAs").otherwise("skos:exactMatch")
    a = table(spark, sf, "part").select(node("p", "p_partkey").alias("x"), F.concat(F.lit("q"), (F.col("p_partkey") % 50).cast("string")).alias("y"), p.alias("p")).where("p = 'owl:sameAs'")
    return a.select(F.col("x").alias("entity"), F.col("y").alias("match")).union(a.select("y", "x")).distinct()


# ---- versions, decisions, stores ----------------------------------------------------------


@query("version_impact", "WITH a AS (SELECT p_partkey AS k, p_brand AS domain, p_size AS label, p_type AS superclasses FROM part WHERE p_partkey % 9 <> 1), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END AS domain, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS label, CASE WHEN p_partkey % 4 = 0 THEN 'y' ELSE p_type END AS superclasses FROM part WHERE p_partkey % 9 <> 2) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'breaking' WHEN a.k IS NULL THEN 'safe' WHEN a.domain <> b.domain THEN 'breaking' WHEN a.superclasses <> b.superclasses THEN 'potentially_breaking' ELSE 'safe' END AS impact FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.domain <> b.domain OR a.label <> b.label OR a.superclasses <> b.superclasses")
def _(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    old = p.where(key % 9 != 1).select(key.alias("k"), F.col("p_brand").alias("domain"), F.col("p_size").alias("label"), F.col("p_type").alias("superclasses"))
    new = p.where(key % 9 != 2).select(key.alias("k"), F.when(key % 7 == 0, "x").otherwise(F.col("p_brand")).alias("domain"), F.when(key % 5 == 0, 0).otherwise(F.col("p_size")).alias("label"), F.when(key % 4 == 0, "y").otherwise(F.col("p_type")).alias("superclasses"))
    found = V.compared(old, new, "k", ["domain", "label", "superclasses"])
    return found.select("k", V.impact(F.col("change"), F.split("fields", ",")).alias("impact"))


@query("decision_trace", "WITH RECURSIVE e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey || ':' || o_orderstatus AS c FROM orders), h AS (SELECT o_custkey, k, sha256('|' || c) AS head FROM e WHERE k = 1 UNION ALL SELECT e.o_custkey, e.k, sha256(h.head || '|' || e.c) FROM h JOIN e ON e.o_custkey = h.o_custkey AND e.k = h.k + 1) SELECT o_custkey, CAST(max(k) AS INTEGER) AS n, arg_max(head, k) AS head FROM h GROUP BY 1")
def _(spark, sf):
    content = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return V.chained(table(spark, sf, "orders"), "o_custkey", F.col("o_orderkey"), content)


@query("decision_policies", "WITH l AS (SELECT p_brand AS policy, p_partkey % 3 AS minor, 'cat' || p_size % 4 AS category, [p_type] AS scope, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3 DESC, p_partkey DESC) AS k FROM part) SELECT 'd' || c_custkey AS decision, policy, '1.' || minor AS version FROM customer JOIN l ON category = 'cat' || c_custkey % 4 AND k = 1 AND list_contains(scope, CASE c_custkey % 2 WHEN 0 THEN 'PROMO' ELSE 'ECONOMY' END)")
def _(spark, sf):
    p = table(spark, sf, "part")
    last = Window.partitionBy("p_brand", F.col("p_partkey") % 3).orderBy(F.desc("p_partkey"))
    policies = p.withColumn("k", F.row_number().over(last)).where("k = 1").select(F.col("p_brand").alias("policy"), F.array(F.lit(1), (F.col("p_partkey") % 3).cast("int")).alias("version"), F.concat(F.lit("cat"), (F.col("p_size") % 4).cast("string")).alias("category"), F.array("p_type").alias("scope"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "PROMO").otherwise("ECONOMY")
    decisions = table(spark, sf, "customer").select(node("d", "c_custkey").alias("decision"), F.concat(F.lit("cat"), (F.col("c_custkey") % 4).cast("string")).alias("category"), F.array(kind).alias("entities"))
    return ST.applicable(policies, decisions)


@query("decision_enforcement", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice / 300000 >= 0.7 THEN NULL ELSE 'min_confidence' END, CASE WHEN o_orderstatus IN ('O', 'F') THEN NULL ELSE 'allowed_outcomes' END, CASE WHEN o_orderkey % 11 = 0 THEN 'required_fields' END, CASE WHEN length(repeat(o_orderpriority, 1 + o_orderkey % 150)) <= 1000 THEN NULL ELSE 'max_reasoning_length' END) AS broken FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    reason = F.repeat("o_orderpriority", (1 + F.col("o_orderkey") % 150).cast("int"))
    field = F.when(F.col("o_orderkey") % 11 != 0, F.lit("x"))
    broken = ST.enforced(F.col("o_totalprice") / 300000, F.col("o_orderstatus"), reason, required=[field, F.col("o_custkey")], outcomes=("O", "F"))
    return o.select("o_orderkey", F.array_join(broken, ",").alias("broken"))


@query("store_upserted", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, coalesce(b.size, a.size) AS size FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name END AS name, p_size + 100 AS size FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k")
def _(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    old = p.where(key % 5 != 0).select(key.alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    changes = p.where(key % 3 == 0).select(key.alias("k"), F.when(key % 2 == 0, F.concat(F.lit("new "), "p_name")).alias("name"), (F.col("p_size") + 100).alias("size"))
    return ST.upserted(old, changes, "k")


@query("store_detached", f"WITH {PLACES} SELECT src, dst FROM pe WHERE src NOT IN ('n3', 'n4') AND dst NOT IN ('n3', 'n4')")
def _(spark, sf):
    g = place_graph(spark, sf)
    _, edges = ST.detached(g.nodes, g.edges, g.nodes.where("id IN ('n3', 'n4')").select("id"))
    return edges.select("src", "dst")


@query("store_merged_mentions", "WITH m AS (SELECT trim(regexp_replace(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) AS entity, p_type AS type, p_brand || repeat('x', p_size) AS d, 'd' || p_partkey % 3 AS source, p_partkey AS seen FROM part) SELECT entity, arg_min(type, seen) AS type, (max({'l': length(d), 'd': d})).d AS description, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM m GROUP BY entity")
def _(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "!").otherwise(""))
    m = table(spark, sf, "part").select(name.alias("name"), F.col("p_type").alias("type"), F.concat("p_brand", F.repeat(F.lit("x"), F.col("p_size"))).alias("description"), F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.col("p_partkey").alias("at"))
    return ST.merged_entities(m)


@query("store_next_versions", "SELECT s_suppkey, s_nationkey || '.' || s_suppkey % 7 || '.' || (s_suppkey % 10 + 1) AS version FROM supplier")
def _(spark, sf):
    v = F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 7).cast("string"), (F.col("s_suppkey") % 10).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", ST.bumped(v).alias("version"))


@query("provenance_translated", "SELECT o_orderkey, round(o_totalprice * 0.9 * 1.2, 6) AS result, 'report' AS layer, 0.8::DOUBLE AS confidence FROM orders")
def _(spark, sf):
    values = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    out = V.translated(values, [("order", "ledger", 0.9, 0.95), ("ledger", "report", 1.2, 0.8)])
    return out.select("o_orderkey", F.round("result", 6).alias("result"), "layer", "confidence")


@query("store_bulk_loaded", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY 1")
def _(spark, sf):
    """Events loaded through a stream, one of a user, kind and day."""
    from graphloom.operators.loops import Saved
    from graphloom.streaming import flows

    path = f"{Saved(spark, 'bulk').root}/table"
    stream = flows.event_stream(spark, f"{sf}/events*.parquet", schema=table(spark, sf, "events").schema)
    flows.loaded(stream.withColumn("day", F.to_date("ts")), "events", path, keys=["user_id", "event_type", "day"])
    # a table of several batches may hold a key once in each
    return spark.read.parquet(path).select("user_id", "event_type", "day").distinct().groupBy("event_type").agg(F.count("*").alias("n"))


@query("store_vectors", "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings WHERE vec_id % 10 <> 3) SELECT vec_id, round(list_sum(e), 5) AS total FROM v")
def _(spark, sf):
    """Vectors updated by id and deleted by id."""
    from graphloom.functions import vectors as VE

    e = table(spark, sf, "embeddings").select("vec_id", VE.doubles(F.col("embedding")).alias("e"))
    changed = e.where("vec_id % 4 = 0").select("vec_id", F.transform("e", lambda x: -x).alias("e"))
    now = ST.upserted(e, changed, "vec_id").join(e.where("vec_id % 10 = 3").select("vec_id"), "vec_id", "left_anti")
    return now.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("decision_records", "SELECT 'd' || o_orderkey AS s, unnest(['about', 'outcome', 'under', 'approved_by']) AS p, unnest(['c' || o_custkey, o_orderstatus, 'policy-' || o_orderpriority[1], 'e' || o_custkey % 40]) AS o FROM orders")
def _(spark, sf):
    """What is recorded of a decision: entity, outcome, policy and approver, as triples."""
    o = table(spark, sf, "orders")
    said = {"about": node("c", "o_custkey"), "outcome": F.col("o_orderstatus"), "under": F.concat(F.lit("policy-"), F.left("o_orderpriority", F.lit(1))), "approved_by": F.concat(F.lit("e"), (F.col("o_custkey") % 40).cast("string"))}
    each = F.array(*[F.struct(F.lit(p).alias("p"), v.alias("o")) for p, v in said.items()])
    return o.select(node("d", "o_orderkey").alias("s"), F.explode(each).alias("x")).select("s", "x.p", "x.o")


@query("version_history", "SELECT o_custkey AS entity, o_orderkey AS version, lag(o_orderkey) OVER w AS previous, o_orderstatus AS state, CASE WHEN lag(o_orderstatus) OVER w IS NULL THEN 'created' WHEN lag(o_orderstatus) OVER w <> o_orderstatus THEN 'changed' ELSE 'kept' END AS change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, sf):
    """Every version of an entity with the one before it and what became of its state."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.lag("o_orderstatus").over(w)
    change = F.when(before.isNull(), "created").when(before != F.col("o_orderstatus"), "changed").otherwise("kept")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("previous"), F.col("o_orderstatus").alias("state"), change.alias("change"))


@query("embed_statements", r"WITH t AS (SELECT 's' || s_suppkey AS id, s_name || ' seat_of nation ' || s_nationkey AS t FROM supplier), w AS (SELECT id, unnest(string_split(lower(t), ' ')) AS w FROM t), n AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM w GROUP BY ALL) SELECT id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS value FROM n")
def _(spark, sf):
    """Relations as texts (subject, predicate, object), embedded by hashed words."""
    text = F.concat_ws(" ", "s_name", F.lit("seat_of nation"), F.col("s_nationkey").cast("string"))
    words = table(spark, sf, "supplier").select(node("s", "s_suppkey").alias("id"), F.explode(F.split(F.lower(text), " ")).alias("w"))
    n = words.groupBy("id", (F.conv(F.substr(F.md5("w"), F.lit(1), F.lit(8)), 16, 10).cast("long") % 64).alias("dim")).agg(F.count("*").alias("n"))
    size = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return n.join(size, "id").select("id", "dim", F.round(F.col("n") / F.col("size"), 9).alias("value"))


@query("graph_degree_and_nations", f"WITH {MARKET}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), d AS (SELECT src AS node, count(*) AS d FROM u GROUP BY 1), k AS (SELECT node, count(*) FILTER (dst LIKE 'n%') AS near FROM d JOIN u ON u.src = node GROUP BY 1) SELECT node, round(d / ((SELECT count(*) FROM d) - 1), 9) AS degree, near AS nations FROM d JOIN k USING (node)")
def _(spark, sf):
    """Degree centrality of every node beside the number of nations next to it."""
    edges = market_graph(spark, sf)
    near = G.adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("dst").startswith("n")).alias("nations"))
    return G.degree_centrality(edges).select("node", F.round("centrality", 9).alias("degree")).join(near, "node")
