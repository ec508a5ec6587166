"""Filters, paging, languages, policies in time, influence, hierarchies, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import dates as DT
from graphloom.functions import text as X
from graphloom.operators.loops import reachable
from graphloom.sources.tables import place_graph, table

Q, S = {}, {}

#: A few of the commonest words of each language.
COMMON = {"de": ["der", "die", "und", "das", "den", "von"], "en": ["the", "of", "and", "to", "is", "that"], "es": ["que", "los", "del", "con", "por", "una"], "fr": ["les", "des", "est", "pour", "une", "dans"]}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("filter_conditions", "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#2' AND p_size > 5 AND p_size <= 40 AND p_retailprice >= 910 AND p_retailprice < 1500 AND contains(p_name, 'i') AND p_type IN ('ECONOMY', 'PROMO', 'STANDARD')")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "part").where((c("p_brand") != "Brand#2") & (c("p_size") > 5) & (c("p_size") <= 40) & (c("p_retailprice") >= 910) & (c("p_retailprice") < 1500) & F.contains("p_name", F.lit("i")) & c("p_type").isin("ECONOMY", "PROMO", "STANDARD")).select("p_partkey")


@query("page_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 70 AND contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_custkey") > 70) & F.contains(F.lower("c_name"), F.lit("1"))).orderBy("c_custkey").limit(25).select("c_custkey", "c_name")


_W = "w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS t FROM documents)"
_K = ", ".join(f"('{lang}', '{word}')" for lang, words in COMMON.items() for word in words)


@query("language_profile", f"WITH {_W}, k(lang, t) AS (VALUES {_K}), n AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN k USING (t) GROUP BY 1, 2) SELECT doc_id, lang AS language, n AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS r FROM n) WHERE r = 1")
def _(spark, sf):
    words = F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")

    def among(known):
        return F.size(F.filter(words, lambda w: w.isin(known)))

    hits = [F.struct((-among(known)).cast("long").alias("n"), F.lit(lang).alias("lang")) for lang, known in COMMON.items()]
    best = table(spark, sf, "documents").select("doc_id", F.array_min(F.array(*hits)).alias("b"))
    return best.where("b.n < 0").select("doc_id", F.col("b.lang").alias("language"), (-F.col("b.n")).alias("hits"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))::INTEGER AS sentences FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


@query("event_pairs", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE")
def _(spark, sf):
    """Events of a user within ten minutes: a range join through ten-minute cells."""
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000)
    e = table(spark, sf, "events")
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"), cell.alias("cell"))
    return a.join(b, ["user_id", "cell"]).where("tb > ta AND tb <= ta + INTERVAL 10 MINUTES").select("a", "b")


@query("causal_strength", "WITH c AS (SELECT event_id, event_type, value, ts, lag(event_id) OVER w AS cause, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT cause, event_id AS effect, round(value / 100 * CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.8 ELSE 0.6 END / (1 + 0.1 * (epoch_us(ts) - epoch_us(before)) / 86400000000.0), 9) AS strength FROM c WHERE cause IS NOT NULL")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = table(spark, sf, "events").withColumn("cause", F.lag("event_id").over(w)).withColumn("before", F.lag("ts").over(w)).where("cause is not null")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 86400000000.0
    factor = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.8).otherwise(0.6)
    return c.select("cause", F.col("event_id").alias("effect"), F.round(F.col("value") / 100 * factor / (1 + 0.1 * days), 9).alias("strength"))


@query("policy_latest_version", "SELECT o_custkey, o_orderkey AS version, o_orderstatus AS rule FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30') WHERE k = 1")
def _(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("1999-06-30").cast("timestamp_ntz"))
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", F.col("b.o_orderkey").alias("version"), F.col("b.o_orderstatus").alias("rule"))


@query("policy_impact", "SELECT o_orderpriority AS category, count(*) AS decisions, CAST(sum((o_totalprice > 200000)::INT) AS BIGINT) AS now_failing, CAST(sum((o_totalprice > 150000)::INT) AS BIGINT) AS then_failing, round(avg((o_totalprice <= 150000)::INT) - avg((o_totalprice <= 200000)::INT), 9) AS change FROM orders GROUP BY 1")
def _(spark, sf):
    p = F.col("o_totalprice")
    change = F.avg((p <= 150000).cast("int")) - F.avg((p <= 200000).cast("int"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("decisions"), F.count_if(p > 200000).alias("now_failing"), F.count_if(p > 150000).alias("then_failing"), F.round(change, 9).alias("change"))


@query("concept_hierarchy", "SELECT 'r' || r_regionkey AS top, 'r' || r_regionkey AS concept, 0 AS level FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, sf):
    g = place_graph(spark, sf)
    tops = g.nodes.where("type = 'region'").select(F.col("id").alias("start"))
    return reachable(g.edges, tops).select(F.col("start").alias("top"), F.col("node").alias("concept"), F.col("hops").alias("level"))


@query("ontology_alignment", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(trim(replace(c_name, 'Customer', ''))) = lower(trim(replace(s_name, 'Supplier', '')))")
def _(spark, sf):
    def name(column, word):
        return F.lower(F.trim(F.replace(F.col(column), F.lit(word), F.lit(""))))

    a, b = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return a.withColumn("k", name("c_name", "Customer")).join(b.withColumn("k", name("s_name", "Supplier")), "k").select("c_custkey", "s_suppkey")


@query("stream_health", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS processed, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS errors, CASE WHEN avg((event_type = 'error')::INT) < 0.1 THEN 'healthy' WHEN avg((event_type = 'error')::INT) < 0.2 THEN 'degraded' ELSE 'unhealthy' END AS health FROM events GROUP BY 1")
def _(spark, sf):
    bad = (F.col("event_type") == "error").cast("int")
    rate = F.avg(bad)
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("processed"), F.sum(bad).alias("errors"), F.when(rate < 0.1, "healthy").when(rate < 0.2, "degraded").otherwise("unhealthy").alias("health"))


@query("date_periods", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day_start, (CAST(o_orderdate AS DATE) + 1)::VARCHAR AS day_end, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarter_start, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE::VARCHAR AS quarter_end FROM orders")
def _(spark, sf):
    d = F.col("o_orderdate")
    day = DT.period(F.date_format(d, "yyyy-MM-dd"), F.lit("2000-01-01").cast("date"))
    quarter = DT.period(F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")), F.lit("2000-01-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", *[x.cast("string").alias(n) for x, n in ((day["start"], "day_start"), (day["end"], "day_end"), (quarter["start"], "quarter_start"), (quarter["end"], "quarter_end"))])


@query("evidence_by_source", "SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("benchmark_matches", "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(spark, sf):
    """Documents that hold a benchmark text whole: the words within an item, six at most, pick
    candidates, and the texts then decide. The first and the last word may be cut in a
    document; items of two words or fewer have none within and are held against every text."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"), words.alias("ws")).withColumn("n", F.least(F.size("ws") - 2, F.lit(6)))
    keyed = items.where("n > 0").select("item_id", "item", F.array_join(F.slice("ws", F.lit(2), F.col("n")), " ").alias("key"))
    sizes = [r.n for r in items.where("n > 0").select("n").distinct().collect()]
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = docs.join(items.where("n <= 0").select("item_id", "item"), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    if sizes:

        def windows(ws, n):
            return F.when(F.size(ws) > n + 1, F.transform(F.sequence(F.lit(2), F.size(ws) - n), lambda k: F.array_join(F.slice(ws, k, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

        every = F.transform(F.array(words), lambda ws: F.concat(*[windows(ws, n) for n in sizes]))[0]
        # a window is eight bytes beside its document: texts are joined to the candidates only
        keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(every, lambda w: F.xxhash64(w)))).alias("key"))
        near = keys.join(keyed.select("item_id", F.xxhash64("key").alias("key")), "key").select("doc_id", "item_id").distinct()
        near = near.join(docs, "doc_id").join(keyed.select("item_id", "item"), "item_id")
        found = found.union(near.where(F.contains("text", F.col("item"))).select("doc_id", "item_id"))
    return found.distinct()


@query("embed_hashed", r"WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS t FROM conversations), n AS (SELECT conv_id, turn, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM w GROUP BY ALL) SELECT conv_id, turn, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 9) AS value FROM n")
def _(spark, sf):
    """A deterministic embedder: words hashed to 64 dimensions, counts brought to length 1."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    each = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(words).alias("t"))
    n = each.groupBy("conv_id", "turn", (F.conv(F.substr(F.md5("t"), F.lit(1), F.lit(8)), 16, 10).cast("long") % 64).alias("dim")).agg(F.count("*").alias("n"))
    size = n.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return n.join(size, ["conv_id", "turn"]).select("conv_id", "turn", "dim", F.round(F.col("n") / F.col("size"), 9).alias("value"))


_SUB = """WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1), s AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE contains(lower(n_name), 'nation_1')),
x AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT u.b, 1 FROM u JOIN s ON u.a = s.id UNION ALL SELECT v.b, 2 FROM u JOIN s ON u.a = s.id JOIN u v ON v.a = u.b), m AS (SELECT id, min(hop) AS hop FROM x GROUP BY id)
SELECT m.id, hop, coalesce(degree, 0) AS degree FROM m LEFT JOIN d ON d.id = m.id ORDER BY hop = 0 DESC, degree DESC, m.id LIMIT 25"""


@query("retrieve_subgraph", _SUB)
def _(spark, sf):
    """Nodes that the question names, two hops around them, the 25 best by seed and degree."""
    from graphloom.operators import graph as G

    g = place_graph(spark, sf)
    edges = g.edges
    seeds = g.nodes.where("type = 'nation'").where(F.contains(F.lower("name"), F.lit("nation_1"))).select(F.col("id").alias("start"))
    near = reachable(G.adjacency(edges), seeds, max_hops=2).groupBy(F.col("node").alias("id")).agg(F.min("hops").alias("hop"))
    ranked = near.join(G.degrees(edges), F.col("id") == F.col("node"), "left").select("id", "hop", F.coalesce("degree", F.lit(0)).alias("degree"))
    return ranked.orderBy((F.col("hop") == 0).desc(), F.desc("degree"), "id").limit(25)


@query("memory_retention", "SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(spark, sf):
    """The last twenty items of a user that are not older than a week."""
    e = table(spark, sf, "events")
    recent = e.where(F.col("ts") >= e.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar())
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return recent.withColumn("k", F.row_number().over(w)).where("k <= 20").select("event_id")
