"""Clusters, overlaps, chains in time, best paths, communities by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import chains as C
from graphloom.operators import clusters as CL
from graphloom.operators import communities as CO
from graphloom.operators import dedup as DD
from graphloom.operators import embeddings as EM
from graphloom.operators import intervals as I
from graphloom.operators import routes as R
from graphloom.operators import semantic as SE
from graphloom.operators import temporal as T
from graphloom.operators import vector_join as VJ
from graphloom.operators.loops import Saved
from graphloom.operators.version_store import VersionStore
from graphloom.plans.knowledge import name_pairs
from graphloom.sources import rdf, writers
from graphloom.sources.readers import triples
from graphloom.sources.tables import node, table
from graphloom.streaming import flows
from graphloom.streaming import matching as MT

Q, S = {}, {}

HOUR = 3_600_000_000
#: Line items (one a line number) as work of their supplier, from the shipping date on, an
#: hour for each piece.
_H = """h AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey, 's' || min(l_suppkey) AS supplier, epoch_us(min(l_shipdate)) AS a, epoch_us(min(l_shipdate)) + CAST(max(l_quantity) AS BIGINT) * 3600000000 AS b
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
#: An order's goods go from the supplier of a line on to that of the next.
_E = _H + """, e AS (SELECT id, supplier AS src, lead(supplier) OVER (PARTITION BY l_orderkey ORDER BY id) AS dst, a, b FROM h QUALIFY dst IS NOT NULL)"""


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def handled(spark: SparkSession, sf: str) -> DataFrame:
    # an order's rows are shuffled once, and then are together for what comes behind
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("supp"), I.micros(F.min("l_shipdate")).alias("start"), F.max("l_quantity").cast("long").alias("n"))
    return rows.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "l_orderkey", node("s", "supp").alias("supplier"), "start", (F.col("start") + F.col("n") * HOUR).alias("end"))


def handovers(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("id")
    rows = handled(spark, sf).select("id", F.col("supplier").alias("src"), F.lead("supplier").over(order).alias("dst"), "start", "end")
    return rows.where("dst is not null")


def weighted_market(spark: SparkSession, sf: str) -> DataFrame:
    """Customers to suppliers by the number of items, suppliers to their nations by the number of
    their items, nations to their customers by the number of orders."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = items.groupBy(node("c", "o_custkey").alias("src"), node("s", "l_suppkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    made = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    seats = table(spark, sf, "supplier").join(made, F.col("s_suppkey") == F.col("l_suppkey")).select(node("s", "s_suppkey"), node("n", "s_nationkey"), "weight")
    asked = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("weight"))
    homes = table(spark, sf, "customer").join(asked, F.col("c_custkey") == F.col("o_custkey")).select(node("n", "c_nationkey"), node("c", "c_custkey"), "weight")
    return bought.union(seats).union(homes)


@query("dedup_average_linkage")
def _(spark, sf):
    return CL.average_linkage(DD.scored(name_pairs(spark, sf)), 0.6)


@query("dedup_cluster_quality")
def _(spark, sf):
    pairs = DD.scored(name_pairs(spark, sf)).select("a", "b", "score")
    return CL.quality(pairs, CL.average_linkage(pairs, 0.6), most=5).withColumn("quality", F.round("quality", 9))


@query("temporal_overlap_join", f"WITH {_H}, p AS (SELECT x.id AS id, y.id AS other, x.a AS a1, x.b AS a2, y.a AS b1, y.b AS b2 FROM h x JOIN h y USING (supplier) WHERE x.id < y.id AND x.a <= y.b AND y.a <= x.b) SELECT id, other, least(a2, b2) - greatest(a1, b1) AS shared, CASE WHEN a2 = b1 THEN 'meets' WHEN a1 = b2 THEN 'met_by' WHEN a1 = b1 AND a2 = b2 THEN 'equals' WHEN a1 = b1 AND a2 < b2 THEN 'starts' WHEN a1 = b1 THEN 'started_by' WHEN a2 = b2 AND a1 > b1 THEN 'finishes' WHEN a2 = b2 THEN 'finished_by' WHEN a1 > b1 AND a2 < b2 THEN 'during' WHEN a1 < b1 AND a2 > b2 THEN 'contains' WHEN a1 < b1 THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM p")
def _(spark, sf):
    rows = handled(spark, sf).select("supplier", "id", "start", "end")
    pairs = I.overlap_join(rows, rows, on=["supplier"]).where("l.id < r.id")
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return pairs.select("l.id", F.col("r.id").alias("other"), shared.alias("shared"), T.allen(at("l.start"), at("l.end"), at("r.start"), at("r.end")).alias("relation"))


@query("temporal_overlap_load", f"WITH {_H} SELECT x.supplier, count(*) AS meetings, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS shared FROM h x JOIN h y ON x.supplier = y.supplier AND x.id < y.id AND x.a < y.b AND y.a < x.b GROUP BY 1")
def _(spark, sf):
    rows = handled(spark, sf).select("supplier", "id", "start", "end")
    pairs = I.overlap_join(rows, rows, on=["supplier"], touching=False).where("l.id < r.id")
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return pairs.groupBy("supplier").agg(F.count("*").alias("meetings"), F.sum(shared).alias("shared"))


_TWO = str(2 * C.DAY)
_NEXT = "s AS (SELECT e.id, f.id AS nxt, f.dst AS nd FROM e JOIN e f ON f.src = e.dst AND f.a >= e.b {0} QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY f.a, f.id) = 1)"


@query("temporal_sequence_patterns", f"WITH RECURSIVE {_E}, {_NEXT.format(f'AND f.a - e.b <= {_TWO} AND f.id <> e.id')}, w AS (SELECT id, id AS cur, src || '>' || dst AS sig, 1 AS n FROM e UNION ALL SELECT w.id, s.nxt, w.sig || '>' || s.nd, w.n + 1 FROM w JOIN s ON s.id = w.cur), f AS (SELECT sig FROM w WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = w.cur)) SELECT sig AS signature, count(*) AS frequency FROM f GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    return C.patterns(C.chains(handovers(spark, sf), tolerance=2 * C.DAY), min_frequency=2)


@query("temporal_event_runs", "WITH w AS (SELECT event_type AS a, lead(event_type) OVER o AS b, lead(event_type, 2) OVER o AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b || '>' || c AS pattern, count(*) AS n FROM w WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def _(spark, sf):
    return T.sequences(table(spark, sf, "events"), "user_id", "ts", "event_type", 3, 5)


@query("temporal_cycle_patterns", f"WITH RECURSIVE {_E}, {_NEXT.format('')}, w AS (SELECT id, id AS cur, [src, dst] AS p FROM e UNION ALL SELECT w.id, s.nxt, list_append(w.p, s.nd) FROM w JOIN s ON s.id = w.cur WHERE len(w.p) < 7 AND w.p[-1] <> w.p[1] AND (NOT list_contains(w.p[2:-2], s.nd) OR s.nd = w.p[1])) SELECT array_to_string(p, '>') AS signature, count(*) AS frequency FROM w WHERE p[-1] = p[1] GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    return C.patterns(C.time_cycles(handovers(spark, sf)), min_frequency=2)


@query("graph_best_paths")
def _(spark, sf):
    return R.best_paths(weighted_market(spark, sf), "c1", "n3", k=3)


@query("graph_widest_paths")
def _(spark, sf):
    return R.best_paths(weighted_market(spark, sf), "c1", "n3", k=3, widest=True)


_MARKET = """m AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL SELECT 's' || s_suppkey, 'n' || any_value(s_nationkey), count(*) FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey
  UNION ALL SELECT 'n' || any_value(c_nationkey), 'c' || c_custkey, count(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"""


@query("graph_widest_ways", f"WITH RECURSIVE {_MARKET}, r AS (SELECT 'c1' AS node, CAST(1e300 AS DOUBLE) AS width UNION SELECT dst, least(width, w) FROM r JOIN m ON src = node) SELECT node, max(width) AS width FROM r GROUP BY 1")
def _(spark, sf):
    return R.widest_rows(weighted_market(spark, sf), "c1").select("node", F.least("width", F.lit(1e300)).alias("width"))


@query("graph_levelled_communities")
def _(spark, sf):
    return CO.levelled(weighted_market(spark, sf), weight="weight").communities


@query("graph_fine_communities")
def _(spark, sf):
    return CO.levelled(weighted_market(spark, sf), weight="weight", resolution=2.0).last()


@query("graph_node_embeddings")
def _(spark, sf):
    out = EM.node_embeddings(weighted_market(spark, sf), walks=2, length=8, window=3, p=1.0, q=0.5)
    return out.select("node", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("vector_similar_pairs", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.35")
def _(spark, sf):
    return VJ.similar_pairs(table(spark, sf, "embeddings"), 0.35, key="vec_id", vector="embedding").withColumn("cosine", F.round("cosine", 6))


_SENTENCES = r"""s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)),
w AS (SELECT doc_id, n, unnest(list_filter(regexp_split_to_array(lower(s), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS w FROM s),
c AS (SELECT doc_id, n, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS b, count(*) AS c FROM w GROUP BY ALL),
z AS (SELECT doc_id, n, sum(c * c) AS z FROM c GROUP BY ALL),
d AS (SELECT x.doc_id, x.n, sum(x.c * y.c) AS d FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.n = x.n + 1 AND x.b = y.b GROUP BY ALL),
i AS (SELECT s.doc_id, s.n, coalesce(CAST(d.d AS DOUBLE) / sqrt(CAST(z.z * y.z AS DOUBLE)), 0.0) AS sim FROM s JOIN (SELECT doc_id, max(n) AS last FROM s GROUP BY 1) l ON l.doc_id = s.doc_id AND s.n < l.last LEFT JOIN d ON d.doc_id = s.doc_id AND d.n = s.n LEFT JOIN z ON z.doc_id = s.doc_id AND z.n = s.n LEFT JOIN z y ON y.doc_id = s.doc_id AND y.n = s.n + 1)"""
_CHUNKS = _SENTENCES + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim, n) AS place, count(*) OVER (PARTITION BY doc_id) AS m FROM i),
l AS (SELECT *, max(CASE WHEN place = greatest(1, ceil(0.25 * m)) THEN sim END) OVER (PARTITION BY doc_id) AS level FROM k),
g AS (SELECT s.doc_id, s.n, s.s, sum(CASE WHEN l.sim < l.level THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.n) AS chunk FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND l.n = s.n - 1)"""


@query("chunk_semantic", f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(n) AS INTEGER) AS first, count(*) AS sentences, md5(string_agg(s, ' ' ORDER BY n)) AS digest FROM g GROUP BY doc_id, chunk")
def _(spark, sf):
    out = SE.semantic_chunks(table(spark, sf, "documents"), key="doc_id", text="text")
    return out.select(F.col("id").alias("doc_id"), "chunk", "first", "sentences", F.md5("text").alias("digest"))


@query("sentence_similarity", f"WITH {_SENTENCES} SELECT doc_id, count(*) AS pairs, round(avg(sim), 9) AS similarity FROM i GROUP BY 1")
def _(spark, sf):
    found = SE.similarities(table(spark, sf, "documents"), key="doc_id", text="text").where(F.size("similarities") > 0)
    mean = F.aggregate("similarities", F.lit(0.0), lambda s, x: s + x) / F.size("similarities")
    return found.select(F.col("id").alias("doc_id"), F.size("similarities").cast("long").alias("pairs"), F.round(mean, 9).alias("similarity"))


# ---- versions of the orders ------------------------------------------------------------


def _versions(spark: SparkSession, sf: str) -> VersionStore:
    """First the orders up to 1997; then all, those that are finished marked so; then without
    the open ones, and one more by its mutations."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    store = VersionStore(spark, Saved(spark, "orders").root, "o_orderkey", orders.schema)
    old = table(spark, sf, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'").select(orders.columns)
    store.commit(old, "old", author="a")
    whole = orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderpriority")))
    store.commit(whole, "whole", author="a")
    store.compact(2)
    store.commit(whole.where("o_orderstatus <> 'O'"), "closed", author="b")
    store.changed(orders.where("o_custkey % 7 = 0 AND o_orderstatus = 'O'"), "reopened", drops=orders.where("o_orderstatus = 'P'"), author="b")
    return store


_V2 = "v2 AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders)"


@query("version_restored", f"WITH {_V2} SELECT 1 AS version, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v2 WHERE o_orderstatus <> 'O' UNION ALL SELECT 4, * FROM v2 WHERE o_orderstatus = 'F' UNION ALL SELECT 4, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 7 = 0 AND o_orderstatus = 'O'")
def _(spark, sf):
    store = _versions(spark, sf)
    out = [store.restored(v).select(F.lit(v).alias("version"), "*") for v in (1, 2, 3, 4)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("version_log", f"WITH {_V2}, v1 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') SELECT 1 AS version, 'old' AS label, count(*) AS puts, 0 AS drops, true AS sound FROM v1 UNION ALL SELECT 2, 'whole', count(*), 0, true FROM (SELECT * FROM v2 EXCEPT SELECT * FROM v1) UNION ALL SELECT 3, 'closed', 0, count(*), true FROM v2 WHERE o_orderstatus = 'O' UNION ALL SELECT 4, 'reopened', count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 7 = 0), count(*) FILTER (o_orderstatus = 'P'), true FROM orders")
def _(spark, sf):
    store = _versions(spark, sf)
    sound = spark.createDataFrame(store.verified(), "version long, sound boolean")
    return store.log().join(sound, "version").select("version", "label", "puts", "drops", "sound")


# ---- what was exported comes back ------------------------------------------------------


@query("import_turtle", "SELECT 'urn:x:c' || c_custkey AS s, 'urn:x:' || p AS p, o FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS p, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS o FROM customer)")
def _(spark, sf):
    facts = triples(table(spark, sf, "customer"), subject=node("c", "c_custkey"), properties={"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"})
    saved = Saved(spark, "turtle")
    writers.turtle(facts, "urn:x:").write.option("maxRecordsPerFile", 50_000).text(f"{saved.root}/files")
    return rdf.read_rdf(spark, f"{saved.root}/files", "turtle").select("s", "p", "o")


@query("import_rdf_xml", "SELECT 'urn:x:p' || p_partkey AS s, 'urn:x:' || p AS p, o FROM (SELECT p_partkey, unnest(['p_name', 'p_size']) AS p, unnest([p_name, CAST(p_size AS VARCHAR)]) AS o FROM part)")
def _(spark, sf):
    parts = table(spark, sf, "part").withColumn("id", node("p", "p_partkey"))
    saved = Saved(spark, "rdf")
    lines = writers.rdf_xml(parts, "id", ["p_name", "p_size"], "urn:x:")
    writers.rdf_documents(lines, {"x": "urn:x:"}).write.option("maxRecordsPerFile", 1).text(f"{saved.root}/files")
    return rdf.read_rdf(spark, f"{saved.root}/files", "rdf_xml").select("s", "p", "o")


# ---- a stream against all that came before ---------------------------------------------


@query("stream_matches", "SELECT x.s_suppkey AS a, y.s_suppkey AS b, round(1 - levenshtein(x.s_name, y.s_name) / greatest(length(x.s_name), length(y.s_name)), 9) AS score FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND right(x.s_name, 1) = right(y.s_name, 1) WHERE 1 - levenshtein(x.s_name, y.s_name) / greatest(length(x.s_name), length(y.s_name)) >= 0.9")
def _(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "supplier").schema).parquet(f"{sf}/supplier*.parquet")
    out = MT.matched(stream, 0.9, key="s_suppkey", name="s_name", blocks=lambda n: F.array(F.right(n, F.lit(1))))
    return flows.drained(out, "matches", mode="append").withColumn("score", F.round("score", 9))
