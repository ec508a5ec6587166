"""Text, rules, versions, lineage, ontology and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import strings as ST
from graphloom.functions import text as X
from graphloom.operators import intervals as I
from graphloom.operators import ontology as O
from graphloom.operators import rules as R
from graphloom.operators import versions as VS
from graphloom.operators.loops import ranked
from graphloom.sources.tables import node, place_graph, table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("text_masked", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP]', 'g'), '\b[0-9]{13,19}\b', '[NUMBER]', 'g')) AS digest FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.masked(F.col("text"))).alias("digest"))


@query("text_private_data_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS INTEGER) AS emails, CAST(len(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS INTEGER) AS addresses FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(X.EMAIL)).alias("emails"), F.regexp_count("text", F.lit(X.IPV4)).alias("addresses"))


@query("text_squeezed", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(ST.squeezed(F.col("text"))).alias("digest"))


@query("html_title", r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.between(F.col("html"), "title").alias("title"))


@query("html_links", """SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(X.links(F.col("html"))).alias("links"))


@query("html_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.without_tags(F.col("html"))).alias("digest"))


@query("html_tag_counts", r"SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY 1")
def _(spark, sf):
    tags = F.regexp_extract_all("html", F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    return table(spark, sf, "pages").select(F.explode(tags).alias("t")).groupBy(F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


@query("json_property", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("number_normalised", "SELECT c_custkey, round(c_acctbal * 1609.344 / 1000, 6) AS km, round(c_acctbal / 60, 6) AS hours FROM customer")
def _(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(X.converted(b, "mi", "km"), 6).alias("km"), F.round(X.converted(b, "min", "h"), 6).alias("hours"))


@query("number_parsed", "SELECT c_custkey, round(c_acctbal, 2) AS value FROM customer")
def _(spark, sf):
    text = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    return table(spark, sf, "customer").select("c_custkey", F.round(X.number(text), 2).alias("value"))


@query("chunk_characters", "WITH c AS (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0)::INT, 1))) AS k FROM documents) SELECT doc_id, CAST(k * 400 AS INTEGER) AS start, md5(substr(text, k * 400 + 1, 500)) AS digest FROM c")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), 500, 100)).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.md5("c.chunk").alias("digest"))


@query("chunk_words", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 40) / 160.0)::INT, 1))) AS k FROM w) SELECT doc_id, CAST(k * 160 AS INTEGER) AS start, md5(coalesce(array_to_string(w[k * 160 + 1 : k * 160 + 200], ' '), '')) AS digest FROM c")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.word_chunks(F.col("text"), 200, 40)).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.md5("c.chunk").alias("digest"))


@query("chunk_lines", "SELECT doc_id, CAST(n AS INTEGER) AS line, md5(l) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE l <> ''")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).where("l <> ''").select("doc_id", "line", F.md5("l").alias("digest"))


@query("chunk_table_rows", "SELECT CAST((r - 1) // 64 AS INTEGER) AS chunk, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last, md5(string_agg(p_partkey || '|' || p_name || '|' || p_brand, chr(10) ORDER BY r)) AS digest FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1")
def _(spark, sf):
    """Rows in order of their key, 64 to a chunk, as lines of fields."""
    line = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("line")
    rows = ranked(table(spark, sf, "part").select(F.lit(0).alias("all"), "p_partkey", line), "all", "p_partkey", name="r")
    chunk = F.floor((F.col("r") - 1) / 64).cast("int").alias("chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(chunk).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"), F.md5(text).alias("digest"))


@query("extract_names", r"SELECT doc_id, e AS entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS e FROM documents) GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.all_of(F.col("text"), X.CAPITALISED)).alias("entity")).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


_AT = r"""m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS e, regexp_split_to_array(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS g FROM documents),
x AS (SELECT doc_id, unnest(e) AS e, unnest(g[1:len(e)]) AS g, generate_subscripts(e, 1) AS k FROM m),
p AS (SELECT doc_id, e, k, sum(length(g) + length(e)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM x), q AS (SELECT *, stop - length(e) AS start FROM p)"""


@query("extract_cooccurrence", f"WITH {_AT} SELECT a.e AS a, b.e AS b, count(*) AS n, CAST(min(b.start - a.stop) AS BIGINT) AS nearest FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.k < b.k AND b.start - a.stop < 100 GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf):
    """Names that follow each other in a text with less than 100 characters between them."""
    found = X.all_of(F.col("text"), X.CAPITALISED)
    both = F.arrays_zip(found.alias("e"), F.slice(F.split("text", X.CAPITALISED, -1), F.lit(1), F.size(found)).alias("g"))
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(both).alias("k", "x")).select("doc_id", "k", F.col("x.e").alias("e"), (F.length("x.e") + F.length("x.g")).alias("n"))
    places = each.select("doc_id", "k", "e", F.sum("n").over(Window.partitionBy("doc_id").orderBy("k")).alias("stop"))
    after = places.select("doc_id", "k", "e", F.col("stop").alias("start"), (F.col("stop") + 99).alias("end"))
    begin = F.col("stop") - F.length("e")
    pairs = I.overlap_join(after, places.select("doc_id", "k", "e", begin.alias("start"), begin.alias("end")), on=["doc_id"], width=100).where("l.k < r.k")
    return pairs.groupBy(F.col("l.e").alias("a"), F.col("r.e").alias("b")).agg(F.count("*").alias("n"), F.min(F.col("r.start") - F.col("l.start")).alias("nearest")).where("n >= 2")


@query("extract_years", r"SELECT page_id, CAST(len(regexp_extract_all(html, '\b(19|20)[0-9]{2}\b')) AS INTEGER) AS years FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(X.all_of(F.col("html"), X.YEAR)).alias("years"))


@query("name_conventions", "SELECT DISTINCT p_type, p_brand, upper(p_type[1]) || lower(p_type[2:]) || 'Part' AS class_name, lower(p_type) || 'Part' AS property_name FROM part")
def _(spark, sf):
    name = F.concat("p_type", F.lit(" part"))
    return table(spark, sf, "part").select("p_type", "p_brand", X.pascal_case(name).alias("class_name"), X.camel_case(name).alias("property_name")).distinct()


# ---- rules ----------------------------------------------------------------------------


@query("rules_datalog_ancestor", "WITH e AS (SELECT 's' || s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer) SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || k, id FROM e UNION SELECT 'r' || n_regionkey, id FROM e JOIN nation ON n_nationkey = k")
def _(spark, sf):
    edges = place_graph(spark, sf).edges
    facts = edges.select(F.lit("parent").alias("pred"), F.array("src", "dst").alias("args"))
    known = R.derived(facts, ["ancestor(X, Y) :- parent(X, Y).", "ancestor(X, Z) :- parent(X, Y), ancestor(Y, Z)."])
    return R.answers(known, "ancestor(A, B)").select(F.col("A").alias("a"), F.col("B").alias("b"))


@query("rules_forward_chain", "SELECT DISTINCT 'c' || o_custkey AS who FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    urgent = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.lit("urgent").alias("pred"), F.array(node("c", "o_custkey")).alias("args"))
    builds = customers.where("c_mktsegment = 'BUILDING'").select(F.lit("builder").alias("pred"), F.array(node("c", "c_custkey")).alias("args"))
    known = R.derived(urgent.union(builds), ["IF urgent(X) AND builder(X) THEN watched(X)", "IF watched(X) THEN review(X)"], rounds=50)
    return R.answers(known, "review(X)").select(F.col("X").alias("who"))


_DUTY = """x AS (SELECT o_orderkey AS po, 'e' || (o_custkey % 40) AS requested_by, 'e' || (min(l_suppkey) % 40) AS approved_by, 'e' || (max(l_partkey) % 40) AS paid_by, 'v' || min(l_suppkey) AS vendor, o_totalprice AS amount
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice),
r AS (SELECT DISTINCT 'e' || (c_custkey % 40) AS employee, CASE c_custkey % 4 WHEN 0 THEN 'role:Director' WHEN 1 THEN 'role:Manager' WHEN 2 THEN 'role:VP' ELSE 'role:Analyst' END AS role FROM customer),
k AS (SELECT x.*, role, 'e' || (s_nationkey % 40) AS relative FROM x LEFT JOIN r ON employee = approved_by LEFT JOIN supplier ON vendor = 'v' || s_suppkey)"""


@query("rules_duty_separation", f"""WITH {_DUTY}
SELECT po, 'SOD-01' AS rule, 'approved and paid by ' || approved_by AS evidence FROM k WHERE approved_by = paid_by
UNION ALL SELECT po, 'SOD-02', 'requested and approved by ' || approved_by FROM k WHERE approved_by = requested_by
UNION ALL SELECT po, 'SOD-03', 'approved by ' || approved_by || ', ' || role FROM k WHERE amount > 25000 AND role IN ('role:Manager', 'role:Analyst')
UNION ALL SELECT po, 'SOD-04', vendor || ' is related to ' || approved_by FROM k WHERE approved_by = relative""")
def _(spark, sf):
    """Orders as purchases: of their customer's, first supplier's and last part's employees."""

    def employee(key):
        return F.concat(F.lit("e"), (key % 40).cast("string"))

    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("po")).agg(F.min("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    orders = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("po"))
    orders = orders.select("po", employee(F.col("o_custkey")).alias("requested_by"), employee(F.col("s")).alias("approved_by"), employee(F.col("p")).alias("paid_by"), node("v", "s").alias("vendor"), F.col("o_totalprice").alias("amount"))
    key = F.col("c_custkey")
    role = F.element_at(F.array(*[F.lit(f"role:{r}") for r in ("Director", "Manager", "VP", "Analyst")]), (key % 4 + 1).cast("int"))
    roles = table(spark, sf, "customer").select(employee(key).alias("employee"), role.alias("role")).distinct()
    related = table(spark, sf, "supplier").select(node("v", "s_suppkey").alias("vendor"), employee(F.col("s_nationkey")).alias("employee"))
    return R.duty_conflicts(orders, roles, related)


@query("rules_policy_compliance", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'min_balance' END, CASE WHEN c_acctbal <= 9000 THEN NULL ELSE 'max_balance' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE 'allowed_segment' END) AS violations FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    found = R.policy({"min_balance": 0, "max_balance": 9000, "allowed_segment": ["BUILDING", "MACHINERY"]}, {"balance": F.col("c_acctbal"), "segment": F.col("c_mktsegment")})
    return c.select("c_custkey", F.array_join(found, ",").alias("violations"))


@query("rules_triple_pattern", "SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, p_type AS kind FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, sf):
    """?s supplies ?p, ?p is of ?kind."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind"))
    return table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(node("s", "l_suppkey").alias("s"), node("p", "l_partkey").alias("p"), "kind").distinct()


# ---- versions, lineage ----------------------------------------------------------------

_OLD, _NEW = "SELECT o_custkey, min(o_orderpriority) AS p, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1", "SELECT o_custkey, min(o_orderpriority) AS p, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-01' AND o_custkey % 50 <> 3 GROUP BY 1"


def _two(spark, sf):
    o = table(spark, sf, "orders")
    def state(rows):
        return rows.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.count("*").alias("n"))

    def before(day):
        return F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")

    return state(o.where(before("1998-01-01"))), state(o.where(before("1998-04-01") & (F.col("o_custkey") % 50 != 3)))


@query("version_compare", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p <> b.p THEN 'p' END, CASE WHEN a.n <> b.n THEN 'n' END) END AS fields FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.p <> b.p OR a.n <> b.n")
def _(spark, sf):
    return VS.compared(*_two(spark, sf), "o_custkey", ["p", "n"])


@query("version_triple_delta", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(spark, sf):
    return VS.delta(*_two(spark, sf))


@query("version_pruned", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 2")
def _(spark, sf):
    return VS.pruned(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", F.col("o_orderkey"), 2).select("o_orderkey")


@query("version_checksum", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS checksum FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", VS.checksum("c_custkey", "c_name", "c_mktsegment").alias("checksum"))


@query("content_key", "SELECT c_custkey, left(sha256(c_name || '|' || c_mktsegment), 24) AS key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", ST.content_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


_MADE = """e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
t AS (SELECT 'o' || o_orderkey AS node, o_orderdate AS f, o_orderdate AS l FROM orders UNION ALL SELECT 's' || s_suppkey, min(l_shipdate), max(l_shipdate) FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey UNION ALL SELECT 'c' || c_custkey, NULL, NULL FROM customer UNION ALL SELECT 'n' || n_nationkey, NULL, NULL FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region)"""


@query("provenance_lineage", f"WITH RECURSIVE {_MADE}, w AS (SELECT 'o' || o_orderkey AS start, 'o' || o_orderkey AS node FROM orders UNION SELECT start, b FROM w JOIN e ON a = node) SELECT start, count(DISTINCT node) - 1 AS ancestors, count(DISTINCT node[1]) AS sources, CAST(min(f) AS VARCHAR) AS first_seen, CAST(max(l) AS VARCHAR) AS last_seen FROM w JOIN t USING (node) GROUP BY start")
def _(spark, sf):
    """What every order goes back to: its customer, its suppliers, their nations and regions."""
    read = lambda name: table(spark, sf, name)
    edges = read("orders").select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    for name, a, b in (("lineitem", node("o", "l_orderkey"), node("s", "l_suppkey")), ("customer", node("c", "c_custkey"), node("n", "c_nationkey")), ("supplier", node("s", "s_suppkey"), node("n", "s_nationkey")), ("nation", node("n", "n_nationkey"), node("r", "n_regionkey"))):
        edges = edges.union(read(name).select(a, b))
    never = F.lit(None).cast("timestamp_ntz")
    shipped = read("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    seen = read("orders").select(node("o", "o_orderkey").alias("node"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    seen = seen.union(read("supplier").join(shipped, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(node("s", "s_suppkey"), "first_seen", "last_seen"))
    for name, key in (("customer", node("c", "c_custkey")), ("nation", node("n", "n_nationkey")), ("region", node("r", "r_regionkey"))):
        seen = seen.union(read(name).select(key, never, never))
    sources = seen.select("node", F.left("node", F.lit(1)).alias("source"), "first_seen", "last_seen")
    out = VS.lineage(edges, read("orders").select(node("o", "o_orderkey").alias("start")), sources)
    return out.withColumn("first_seen", F.col("first_seen").cast("string")).withColumn("last_seen", F.col("last_seen").cast("string"))


# ---- ontology and data quality ---------------------------------------------------------


@query("ontology_classes", "WITH e AS (SELECT p_type AS class, CASE WHEN p_size > 10 THEN p_brand END AS p_brand, p_name, CASE WHEN p_size > 40 THEN p_size END AS p_size FROM part), n AS (SELECT class, count(*) AS n, count(p_brand) AS a, count(p_name) AS b, count(p_size) AS c FROM e GROUP BY 1) SELECT class, n, property FROM (SELECT class, n, 'p_brand' AS property, a AS k FROM n UNION ALL SELECT class, n, 'p_name', b FROM n UNION ALL SELECT class, n, 'p_size', c FROM n) WHERE n >= 2 AND k >= 0.5 * n")
def _(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_type").alias("type"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"), "p_name", F.when(F.col("p_size") > 40, F.col("p_size")).alias("p_size"))
    return O.classes(e, ["p_brand", "p_name", "p_size"])


@query("ontology_object_properties", "SELECT 'contains' AS property, count(*) AS n, 'region' AS domains, 'nation' AS ranges FROM nation UNION ALL SELECT 'home_of', count(*), 'nation', 'customer' FROM customer UNION ALL SELECT 'seat_of', count(*), 'nation', 'supplier' FROM supplier")
def _(spark, sf):
    g = place_graph(spark, sf)
    kind = g.nodes.select("id", F.col("type").alias("kind"))
    rel = g.edges.join(kind.select(F.col("id").alias("src"), F.col("kind").alias("source_type")), "src").join(kind.select(F.col("id").alias("dst"), F.col("kind").alias("target_type")), "dst")
    return O.object_properties(rel)


@query("ontology_data_properties", "SELECT 'c_custkey' AS property, 'integer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'c_acctbal', 'decimal', count(*) FROM customer UNION ALL SELECT 'c_name', 'string', count(*) FROM customer")
def _(spark, sf):
    return O.data_properties(table(spark, sf, "customer"), ["c_custkey", "c_acctbal", "c_name"])


@query("ontology_cardinality", "SELECT o_custkey AS subject, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 5 OR count(*) > 15")
def _(spark, sf):
    values = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("value"))
    return O.cardinality(values, low=5, high=15)


@query("ontology_constraints", "SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'pattern' END, CASE WHEN c_acctbal < 0 THEN 'minInclusive' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN 'in' END) AS failed FROM customer")
def _(spark, sf):
    bad = R.violations(("pattern", F.col("c_name").rlike("^Customer#[0-9]{9}$")), ("minInclusive", F.col("c_acctbal") >= 0), ("in", F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(bad, ",").alias("failed"))


@query("quality_missing", "SELECT 'l_orderkey' AS field, count(*) - count(l_orderkey) AS missing, round(100.0 * (count(*) - count(l_orderkey)) / count(*), 6) AS percent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey), round(100.0 * (count(*) - count(o_orderkey)) / count(*), 6) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fields = ["l_orderkey", "o_orderkey"]
    one = rows.agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col("n") - F.col(f)).alias("missing"), F.round(100.0 * (F.col("n") - F.col(f)) / F.col("n"), 6).alias("percent")) for f in fields])).alias("x")).select("x.*")


@query("quality_imputed", "WITH m AS (SELECT c_mktsegment, avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) AS mean FROM customer GROUP BY 1) SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE mean END, 6) AS balance FROM customer JOIN m USING (c_mktsegment)")
def _(spark, sf):
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    c = table(spark, sf, "customer")
    means = c.groupBy("c_mktsegment").agg(F.avg(known).alias("mean"))
    return c.join(means, "c_mktsegment").select("c_custkey", F.round(F.coalesce(known, F.col("mean")), 6).alias("balance"))


@query("report_cube", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")
