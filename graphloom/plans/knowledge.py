"""Similarity, retrieval, duplicates, conflicts, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import strings as ST
from graphloom.functions import vectors as V
from graphloom.operators import conflicts as C
from graphloom.operators import dedup as DD
from graphloom.operators import search as SE
from graphloom.operators.loops import Saved, components, ranked
from graphloom.sources.tables import table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def one_vector(spark, sf, vec_id=0):
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding)


_X = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT v AS w FROM x WHERE vec_id = 0)"
for _m, _sql in {
    "cosine": "list_cosine_similarity(v, w)",
    "euclidean": "1 / (1 + list_distance(v, w))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))))",
    "correlation": "list_cosine_similarity(list_transform(v, lambda a: a - list_avg(v)), list_transform(w, lambda a: a - list_avg(w)))",
}.items():
    S[f"vector_topk_{_m}"] = f"WITH {_X} SELECT vec_id, round({_sql}, 9) AS score FROM x, q ORDER BY score DESC, vec_id LIMIT 10"

    def _topk(spark, sf, m=_m):
        return SE.top_similar(table(spark, sf, "embeddings"), one_vector(spark, sf), 10, key="vec_id", vector="embedding", method=m)

    Q[f"vector_topk_{_m}"] = _topk


@query("vector_hybrid_filtered", f"WITH {_X} SELECT vec_id, round(list_cosine_similarity(v, w), 9) AS score FROM x, q WHERE label IN (1, 2, 3) AND vec_id >= 100 ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    rows = SE.filtered(table(spark, sf, "embeddings"), {"label": [1, 2, 3], "vec_id": {"min": 100}})
    return SE.top_similar(rows, one_vector(spark, sf), 10, key="vec_id", vector="embedding")


@query("vector_pooling", "WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS mean, round(max(x), 9) AS most FROM x GROUP BY 1, 2")
def _(spark, sf):
    return SE.pooled(table(spark, sf, "embeddings"), by="label", vector="embedding").select("label", "dim", F.round("mean", 9).alias("mean"), F.round("most", 9).alias("most"))


@query("vector_normalised", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda a: a * a))), 9) AS length, len(embedding)::INTEGER AS dims FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 9).alias("length"), F.size("embedding").alias("dims"))


_F = f"WITH {_X}, r AS (SELECT 'cosine' AS source, vec_id AS id, round(list_cosine_similarity(v, w), 9) AS score FROM x, q UNION ALL SELECT 'near', vec_id, round(1 / (1 + list_distance(v, w)), 9) FROM x, q)"


def both_rankings(spark, sf):
    rows = table(spark, sf, "embeddings")
    q, v = F.array(*[F.lit(float(x)) for x in one_vector(spark, sf)]), V.doubles(F.col("embedding"))
    parts = F.array(F.struct(F.lit("cosine").alias("source"), F.round(V.cosine(v, q), 9).alias("score")), F.struct(F.lit("near").alias("source"), F.round(V.closeness(V.euclidean(v, q)), 9).alias("score")))
    return rows.select(F.col("vec_id").alias("id"), F.explode(parts).alias("p")).select("id", "p.source", "p.score")


@query("fusion_reciprocal_rank", _F + ", k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM r) SELECT id, round(sum(1 / (60 + rank)), 9) AS score FROM k GROUP BY id")
def _(spark, sf):
    return SE.reciprocal_rank_fusion(both_rankings(spark, sf)).withColumn("score", F.round("score", 9))


@query("fusion_weighted", _F + " SELECT id, round(sum(score * CASE source WHEN 'cosine' THEN 0.7 ELSE 0.3 END), 10) AS score FROM r GROUP BY id")
def _(spark, sf):
    return SE.weighted_fusion(both_rankings(spark, sf), {"cosine": 0.7, "near": 0.3}).withColumn("score", F.round("score", 10))


@query("fusion_rank_and_merge", _F + ", m AS (SELECT *, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM r) SELECT id, round(max(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score END) * 1.2, 8) AS score FROM m GROUP BY id")
def _(spark, sf):
    return SE.min_max_merged(both_rankings(spark, sf)).withColumn("score", F.round("score", 8))


@query("keyword_search", "SELECT doc_id, round((contains(lower(text), 'the') :: INT + contains(lower(text), 'queaux') :: INT + contains(lower(text), 'ung') :: INT) / 3, 9) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'queaux') OR contains(lower(text), 'ung')")
def _(spark, sf):
    return SE.keyword_search(table(spark, sf, "documents"), "the queaux ung", text="text").select("doc_id", F.round("score", 9).alias("score"))


@query("context_budget", "SELECT conv_id, turn, spent, spent <= 400 AS kept FROM (SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations)")
def _(spark, sf):
    return SE.budgeted(table(spark, sf, "conversations"), key="conv_id", order=[F.col("turn")], cost=F.coalesce(F.length("text"), F.lit(0)), budget=400).select("conv_id", "turn", "spent", "kept")


@query("memory_counts", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


@query("memory_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "turn", "role")


# ---- decisions: orders, category by priority, outcome by status ------------------------


@query("decision_insights", "SELECT o_orderpriority AS category, o_orderstatus AS outcome, count(*) AS n, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("decision_upper_median", "SELECT category, o_totalprice AS median FROM (SELECT o_orderpriority AS category, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2")
def _(spark, sf):
    # the value at place n div 2 of the sorted values; a category's rows are ranked by many tasks
    prices = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), "o_totalprice", "o_orderkey")
    placed = ranked(prices, "category", "o_totalprice", "o_orderkey")
    sizes = Saved(spark, "sizes").save(prices.groupBy("category").agg(F.floor(F.count("*") / 2).alias("m")))
    return placed.join(sizes, "category").where("rank = m + 1").select("category", F.col("o_totalprice").alias("median"))


@query("decision_top_entities", "SELECT o_custkey AS entity, count(*) AS decisions FROM orders GROUP BY 1 ORDER BY decisions DESC, entity LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("decisions")).orderBy(F.desc("decisions"), "entity").limit(10)


@query("decision_filtered", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 150000 AND o_orderdate >= TIMESTAMP '1997-01-01'")
def _(spark, sf):
    rows = SE.filtered(table(spark, sf, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": "F", "o_totalprice": {"min": 100000, "max": 150000}})
    return rows.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("decision_precedents", "WITH p AS (SELECT p_partkey, p_type, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), q AS (SELECT * FROM p WHERE p_partkey = 7), s AS (SELECT p.p_partkey, round(0.7 * len(list_intersect(p.w, q.w)) / len(list_distinct(list_concat(p.w, q.w))) + 0.3 * (p.p_type = q.p_type)::INT, 9) AS score FROM p, q WHERE p.p_partkey <> 7) SELECT * FROM s WHERE score >= 0.5")
def _(spark, sf):
    parts = table(spark, sf, "part")
    one = parts.where("p_partkey = 7").first()
    want = F.array(*[F.lit(w) for w in dict.fromkeys(one.p_name.lower().split())])
    score = 0.7 * ST.jaccard(ST.words(F.col("p_name")), want) + 0.3 * (F.col("p_type") == one.p_type).cast("int")
    return parts.where("p_partkey <> 7").select("p_partkey", F.round(score, 9).alias("score")).where("score >= 0.5")


@query("decision_influence", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM orders) SELECT a.o_orderkey AS a, b.o_orderkey AS b, round(0.5 + 0.3 * (a.o_orderpriority = b.o_orderpriority)::INT + 0.2 * greatest(0, 1 - date_diff('day', a.o_orderdate, b.o_orderdate) / 30.0), 9) AS score FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY")
def _(spark, sf):
    # a later order of the same customer within 30 days: met through the period it falls in
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    period = F.floor(F.unix_date("day") / 30)
    a = o.select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("o_orderpriority").alias("pa"), F.col("day").alias("da"), F.explode(F.array(period, period + 1)).alias("period"))
    b = o.select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("o_orderpriority").alias("pb"), F.col("day").alias("db"), period.alias("period"))
    apart = F.date_diff("db", "da")
    score = 0.5 + 0.3 * (F.col("pa") == F.col("pb")).cast("int") + 0.2 * F.greatest(F.lit(0.0), 1 - apart / 30.0)
    return a.join(b, ["o_custkey", "period"]).where((apart > 0) & (apart <= 30)).select("a", "b", F.round(score, 9).alias("score"))


# ---- duplicates -----------------------------------------------------------------------

_B = "n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS t FROM n), k AS (SELECT DISTINCT name, t[1:4] AS block FROM w WHERE length(t) > 2), p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM k a JOIN k b ON a.block = b.block AND a.name < b.name)"


def name_pairs(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return DD.candidates(names, key="id", name="name", keys=ST.block_keys(F.col("name")))


@query("dedup_candidates", f"WITH {_B} SELECT a, b FROM p")
def _(spark, sf):
    return name_pairs(spark, sf).select("a", "b")


@query("dedup_levenshtein", f"WITH {_B} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) AS score FROM p")
def _(spark, sf):
    return DD.scored(name_pairs(spark, sf)).select("a", "b", F.round("score", 9).alias("score"))


@query("dedup_bigram_jaccard", f"WITH {_B}, g AS (SELECT name, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS s FROM n) SELECT a, b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 9) AS score FROM p JOIN g x ON x.name = a JOIN g y ON y.name = b")
def _(spark, sf):
    return DD.scored(name_pairs(spark, sf), "bigram").select("a", "b", F.round("score", 9).alias("score"))


@query("dedup_character_jaccard", f"WITH {_B}, g AS (SELECT name, list_distinct(string_split(name, '')) AS s FROM n) SELECT a, b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 9) AS score FROM p JOIN g x ON x.name = a JOIN g y ON y.name = b")
def _(spark, sf):
    return DD.scored(name_pairs(spark, sf), "characters").select("a", "b", F.round("score", 9).alias("score"))


_G = _B + ", s AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM p), l AS (SELECT a, b, score FROM s WHERE score >= 0.7), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)"


@query("dedup_groups", f"WITH RECURSIVE {_G} SELECT node, min(reach) AS component FROM r GROUP BY node")
def _(spark, sf):
    return DD.groups(DD.scored(name_pairs(spark, sf)).where("score >= 0.7"))


@query("dedup_group_confidence", f"WITH RECURSIVE {_G}, c AS (SELECT node, min(reach) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT component, any_value(size) AS size, round(avg(score) * (0.8 + 0.2 * least(1.0, any_value(size) / 5)), 9) AS confidence FROM l JOIN c ON c.node = l.a JOIN z USING (component) GROUP BY component")
def _(spark, sf):
    pairs = DD.scored(name_pairs(spark, sf)).where("score >= 0.7")
    return DD.group_confidence(pairs, components(pairs)).withColumn("confidence", F.round("confidence", 9))


for _s, _p in {"keep_first": "arg_min(p_brand, p_partkey)", "keep_last": "arg_max(p_brand, p_partkey)", "longest": "arg_min(p_brand, struct_pack(a := -length(p_brand), b := p_partkey))"}.items():
    S[f"dedup_merge_{_s}"] = f"SELECT p_name, count(*) AS merged, {_p} AS p_brand FROM part GROUP BY p_name"

    def _merge(spark, sf, s=_s):
        return DD.merged(table(spark, sf, "part"), by=["p_name"], order=[F.col("p_partkey")], properties=["p_brand"], strategy=s)

    Q[f"dedup_merge_{_s}"] = _merge


@query("dedup_exact_documents", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(spark, sf):
    # grouped by a digest of the text, so that texts are not shuffled
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


_I = """kb AS (SELECT DISTINCT p_name AS name, unnest(list_transform(list_filter(string_split(p_name, ' '), lambda t: length(t) > 2), lambda t: t[1:4])) AS block FROM part),
o AS (SELECT p_name AS name, min(p_partkey) AS match FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1),
m AS (SELECT DISTINCT x.name, o.match, round(1 - levenshtein(x.name, o.name) / greatest(length(x.name), length(o.name)), 9) AS score FROM kb x JOIN kb y ON x.block = y.block JOIN o ON o.name = y.name),
f AS (SELECT * FROM m WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, match) = 1)"""


@query("dedup_incremental", f"WITH {_I} SELECT p_partkey, match, score FROM part LEFT JOIN f ON p_name = name WHERE p_partkey % 10 = 0")
def _(spark, sf):
    """Every tenth part is new, and is held against all others."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    out = DD.incremental(parts.where("p_partkey % 10 = 0"), parts.where("p_partkey % 10 <> 0"), 0.5, key="p_partkey", name="p_name", blocks=ST.block_keys)
    return out.select("p_partkey", "match", F.round("score", 9).alias("score"))


# ---- conflicts: what each event says of its user's kind -------------------------------

_C = "c AS (SELECT user_id AS entity, 'kind' AS property, event_type AS value, 's' || (event_id % 7) AS source, value / 100 AS confidence, ts, event_id AS pos FROM events)"


def claims(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.lit("kind").alias("property"), F.col("event_type").alias("value"), F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias("source"), (F.col("value") / 100).alias("confidence"), "ts", F.col("event_id").alias("pos"))


def credibility(spark, sf):
    return claims(spark, sf).groupBy("source").agg(F.round(F.avg("confidence"), 9).alias("credibility"))


@query("conflict_values", f"WITH {_C}, g AS (SELECT entity, property, count(*) AS n, count(DISTINCT value) AS distinct_values, avg(confidence) AS m FROM c WHERE value IS NOT NULL GROUP BY 1, 2) SELECT entity, property, n, distinct_values, round(least(1.0, m * (1 + distinct_values / n)), 9) AS confidence FROM g WHERE n >= 2 AND distinct_values > 1")
def _(spark, sf):
    return C.value_conflicts(claims(spark, sf)).select("entity", "property", "n", "distinct_values", F.round(C.confidence(), 9).alias("confidence"))


@query("conflict_voting", f"WITH {_C}, v AS (SELECT entity, property, value, count(*) AS w, min(pos) AS first FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY w DESC, first) AS k, sum(w) OVER (PARTITION BY entity, property) AS total FROM v) SELECT entity, property, value, round(w / total, 9) AS confidence FROM k WHERE k = 1")
def _(spark, sf):
    return C.resolved(claims(spark, sf), "voting").withColumn("confidence", F.round("confidence", 9))


@query("conflict_credibility", f"WITH {_C}, r AS (SELECT source, round(avg(confidence), 9) AS credibility FROM c GROUP BY 1), v AS (SELECT entity, property, value, sum(coalesce(confidence, 0.5) * coalesce(credibility, 0.5)) AS w, min(pos) AS first FROM c LEFT JOIN r USING (source) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY round(w, 9) DESC, first) AS k, sum(w) OVER (PARTITION BY entity, property) AS total FROM v) SELECT entity, property, value, round(w / total, 8) AS confidence FROM k WHERE k = 1")
def _(spark, sf):
    return C.resolved(claims(spark, sf), "credibility_weighted", credibility(spark, sf)).withColumn("confidence", F.round("confidence", 8))


for _s, _p in {"most_recent": "arg_max(value, struct_pack(a := ts, b := -pos)) AS value, 0.8::DOUBLE", "first_seen": "arg_min(value, pos) AS value, 0.7::DOUBLE", "highest_confidence": "arg_max(value, struct_pack(a := confidence, b := -pos)) AS value, round(max(confidence), 9)"}.items():
    S[f"conflict_{_s}"] = f"WITH {_C} SELECT entity, property, {_p} AS confidence FROM c GROUP BY 1, 2"

    def _resolve(spark, sf, s=_s):
        return C.resolved(claims(spark, sf), s).withColumn("confidence", F.round("confidence", 9))

    Q[f"conflict_{_s}"] = _resolve


@query("conflict_analysis", f"WITH {_C} SELECT 'value' AS dimension, value, count(*) AS n FROM c GROUP BY value UNION ALL SELECT 'source', source, count(*) FROM c GROUP BY source UNION ALL SELECT 'property', property, count(*) FROM c GROUP BY property")
def _(spark, sf):
    return C.counted(claims(spark, sf), ["value", "source", "property"])


@query("conflict_patterns", f"WITH {_C} SELECT source, value, count(DISTINCT entity) AS entities FROM c GROUP BY 1, 2 HAVING count(DISTINCT entity) > 100")
def _(spark, sf):
    return claims(spark, sf).groupBy("source", "value").agg(F.countDistinct("entity").alias("entities")).where("entities > 100")


@query("conflict_types", f"WITH {_C} SELECT entity, string_agg(DISTINCT value, ',' ORDER BY value) AS types FROM c GROUP BY entity HAVING bool_or(value = 'error') AND bool_or(value = 'purchase')")
def _(spark, sf):
    rows = claims(spark, sf).select("entity", F.col("value").alias("type"))
    return C.types_in_conflict(rows, [("error", "purchase")])


@query("conflict_severity", f"SELECT o_custkey AS entity, CASE WHEN max(o_totalprice) - min(o_totalprice) > 1000 THEN 'high' ELSE 'medium' END AS severity FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(C.severity(F.lit("price"), F.max("o_totalprice") - F.min("o_totalprice")).alias("severity"))


@query("conflict_source_disagreements", f"WITH {_C} SELECT entity, source, count(DISTINCT value) AS says FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def _(spark, sf):
    return claims(spark, sf).groupBy("entity", "source").agg(F.countDistinct("value").alias("says")).where("says > 1")
