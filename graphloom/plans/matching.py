"""Similarity, conflicts, chunking and extraction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import strings as ST
from graphloom.functions import text as X
from graphloom.operators import conflicts as C
from graphloom.operators import dedup as D
from graphloom.operators import graph as G
from graphloom.operators.loops import Saved
from graphloom.sources.tables import table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


# ---- similarity of entities -------------------------------------------------------------

_NEXT = "p AS (SELECT c_custkey AS a, c_name AS name_a, c_nationkey AS nation_a, c_mktsegment AS type_a, lead(c_custkey, {k}) OVER w AS b, lead(c_name, {k}) OVER w AS name_b, lead(c_nationkey, {k}) OVER w AS nation_b, lead(c_mktsegment, {k}) OVER w AS type_b FROM customer WINDOW w AS (PARTITION BY left(c_name, 16) ORDER BY c_name, c_custkey))"
_PAIRS = f"WITH pairs AS ({' UNION ALL '.join('(WITH ' + _NEXT.format(k=k) + ' SELECT * FROM p WHERE b IS NOT NULL)' for k in (1, 2, 3))})"


def _pairs(spark, sf):
    """Customers and the three after them by name, of those whose names start alike."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("type"))
    return D.neighbours(rows, key="c_custkey", block=F.left("name", F.lit(16)), order=["name", "c_custkey"], reach=3)


@query("dedup_neighbours", f"{_PAIRS} SELECT a, b FROM pairs")
def _(spark, sf):
    return _pairs(spark, sf).select("a", "b")


_SOUND = "left(upper(n[1]) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(upper(n[2:]), '[^BFPVCGJKQSXZDTLMNR]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') || '000', 4)"


@query("similarity_soundex", f"SELECT p_partkey, {_SOUND} AS code FROM (SELECT p_partkey, p_name AS n FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ST.soundex(F.col("p_name")).alias("code"))


@query("similarity_jaro_winkler")
def _(spark, sf):
    p = _pairs(spark, sf)
    return p.select("a", "b", F.round(ST.jaro_winkler(F.col("name_a"), F.col("name_b")), 9).alias("score"))


_LEV = "CASE WHEN lower(name_a) = lower(name_b) THEN 1.0 ELSE 1 - levenshtein(lower(name_a), lower(name_b)) / greatest(length(name_a), length(name_b)) END"
_PROPS = "((CASE WHEN type_a = type_b THEN 1.0 ELSE 1 - levenshtein(lower(type_a), lower(type_b)) / greatest(length(type_a), length(type_b)) END) + (CASE WHEN nation_a = nation_b THEN 1.0 ELSE 1 - levenshtein(nation_a::VARCHAR, nation_b::VARCHAR) / greatest(length(nation_a::VARCHAR), length(nation_b::VARCHAR)) END)) / 2"


@query("similarity_weighted", f"{_PAIRS} SELECT a, b, round((0.6 * ({_LEV}) + 0.2 * ({_PROPS})) / 0.8, 9) AS score FROM pairs")
def _(spark, sf):
    """Names 0.6, properties 0.2; relations, which these rows lack, are left out of the mean."""
    p = _pairs(spark, sf)
    names = ST.string_similarity(F.col("name_a"), F.col("name_b"), "levenshtein")
    properties = ST.property_similarity([(F.col("type_a"), F.col("type_b")), (F.col("nation_a").cast("string"), F.col("nation_b").cast("string"))], "levenshtein")
    return p.select("a", "b", F.round(ST.weighted([(0.6, names), (0.2, properties), (0.2, F.lit(None).cast("double"))]), 9).alias("score"))


@query("similarity_relations", "WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM l GROUP BY 1), k AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM l x JOIN l y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2) SELECT a, b, round(k / (x.n + y.n - k), 9) AS score FROM k JOIN n x ON x.s = a JOIN n y ON y.s = b")
def _(spark, sf):
    """Suppliers that share a part, by the share of their parts that they have in common."""
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    own = Saved(spark, "shares").save(own.where("s is not null"))
    n, members = G.numbered(own.groupBy("s").agg(F.count("*").alias("n")), "s")
    met = G.shared_pairs(own.join(n, "s").select(F.col("p").alias("via"), F.col("id").alias("member")), members).withColumnRenamed("shared", "k")
    met = met.join(n.select(F.col("id").alias("u"), F.col("s").alias("a"), F.col("n").alias("x")), "u").join(n.select(F.col("id").alias("v"), F.col("s").alias("b"), F.col("n").alias("y")), "v")
    return met.select("a", "b", F.round(F.col("k") / (F.col("x") + F.col("y") - F.col("k")), 9).alias("score"))


@query("similarity_prefilter", f"{_PAIRS} SELECT a, b, CASE WHEN type_a <> type_b THEN 'type_mismatch' WHEN least(length(name_a), length(name_b)) / greatest(length(name_a), length(name_b)) < 0.3 THEN 'length_ratio_below_0.3' END AS reason FROM pairs")
def _(spark, sf):
    p = _pairs(spark, sf)
    return p.select("a", "b", ST.rejected(F.col("name_a"), F.col("name_b"), F.col("type_a"), F.col("type_b")).alias("reason"))


@query("similarity_combined_vectors", "WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS s, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS t FROM embeddings), q AS (SELECT * FROM v WHERE vec_id = 0) SELECT v.vec_id, round(0.7 * list_cosine_similarity(v.s, q.s) + 0.3 * list_cosine_similarity(v.t, q.t), 6) AS score FROM v, q WHERE v.vec_id <> 0")
def _(spark, sf):
    """Semantic (the first half) and structural similarity (the second) to one row, 0.7 to 0.3."""
    from graphloom.functions import vectors as V

    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]

    def part(a, b):
        return V.cosine(V.doubles(F.slice("embedding", a + 1, b - a)), F.array(*[F.lit(float(x)) for x in q[a:b]]))

    return e.where("vec_id <> 0").select("vec_id", F.round(0.7 * part(0, 32) + 0.3 * part(32, 64), 6).alias("score"))


@query("dedup_relations", "WITH r AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus || '-' || o_orderkey % 7 AS object FROM orders), p AS (SELECT a.subject, a.predicate AS pa, a.object AS oa, b.predicate AS pb, b.object AS ob FROM r a JOIN r b ON a.subject = b.subject AND (a.predicate, a.object) < (b.predicate, b.object)), s AS (SELECT *, 0.6 * (CASE WHEN pa = pb THEN 1.0 ELSE 1 - levenshtein(lower(pa), lower(pb)) / greatest(length(pa), length(pb)) END) + 0.4 * (CASE WHEN oa = ob THEN 1.0 ELSE 1 - levenshtein(lower(oa), lower(ob)) / greatest(length(oa), length(ob)) END) AS score FROM p) SELECT subject, pa, oa, pb, ob, round(score, 9) AS score FROM s WHERE score >= 0.85")
def _(spark, sf):
    """Relations of one subject whose predicates and objects are alike."""
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.concat_ws("-", "o_orderstatus", (F.col("o_orderkey") % 7).cast("string")).alias("object")).distinct()
    return D.alike_relations(r, threshold=0.85, method="levenshtein").withColumn("score", F.round("score", 9))


@query("entity_links", "WITH a AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), k AS (SELECT DISTINCT p_name, w FROM a), t AS (SELECT p_name, w, unnest(w) AS x FROM k), c AS (SELECT DISTINCT a.p_name AS name, b.p_name AS other, a.w AS u, b.w AS v FROM t a JOIN t b ON a.x = b.x AND a.p_name < b.p_name) SELECT name, other, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 9) AS score FROM c")
def _(spark, sf):
    """Distinct names that share a word, by the Jaccard similarity of their words."""
    names = table(spark, sf, "part").select("p_name").distinct().withColumn("w", F.split("p_name", " "))
    return D.linked_names(names, name="p_name", words="w").withColumn("score", F.round("score", 9))


@query("entity_names", "SELECT s_suppkey, s_name AS name, 'https://example.org/entity/' || lower(replace(s_name, '#', '%23')) || '#supplier' AS uri FROM supplier")
def _(spark, sf):
    """Names without titles, and the address of each entity."""
    titled = F.concat(F.element_at(F.array(*[F.lit(t) for t in ST.TITLES]), (F.col("s_suppkey") % len(ST.TITLES) + 1).cast("int")), F.lit("  "), "s_name")
    rows = table(spark, sf, "supplier").select("s_suppkey", ST.without_titles(titled).alias("name"))
    return rows.withColumn("uri", F.concat(F.lit("https://example.org/entity/"), F.lower(F.replace("name", F.lit("#"), F.lit("%23"))), F.lit("#supplier")))


@query("entity_aliases", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Basic' WHEN 'PROMO' THEN 'Offer' ELSE p_type END AS canonical FROM part")
def _(spark, sf):
    aliases = spark.createDataFrame([("economy", "Basic"), ("promo", "Offer")], "alias string, canonical string")
    return D.resolved(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", aliases).select("p_partkey", "canonical")


@query("encoding_repaired", "SELECT c_custkey, c_name || ' é' AS name, CAST(c_custkey % 3 <> 2 AS BOOLEAN) AS valid FROM customer")
def _(spark, sf):
    """Bytes with a mark, plain, and in Latin-1, brought back to text."""
    name = F.concat("c_name", F.lit(" é"))
    k = F.col("c_custkey") % 3
    data = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(name, "UTF-8"))).when(k == 1, F.encode(name, "UTF-8")).otherwise(F.encode(name, "ISO-8859-1"))
    rows = table(spark, sf, "customer").select("c_custkey", data.alias("data"))
    return rows.select("c_custkey", X.as_utf8(F.col("data")).alias("name"), F.is_valid_utf8(X.without_bom(F.col("data")).cast("string")).alias("valid"))


# ---- conflicts --------------------------------------------------------------------------


@query("conflict_temporal", "WITH d AS (SELECT o_orderkey AS id, 'start_date' AS property, strftime(l_shipdate, '%d.%m.%Y') AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, 'start_date', strftime(o_orderdate, '%Y-%m-%d') FROM orders), y AS (SELECT id, property, regexp_extract(value, '(19|20)[0-9]{2}') AS y FROM d) SELECT id, property, count(DISTINCT y) AS years, min(y) AS first, max(y) AS last FROM y WHERE y <> '' GROUP BY 1, 2 HAVING count(DISTINCT y) > 1")
def _(spark, sf):
    """Dates of one order, as sources write them, that tell different years."""
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    said = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("start_date"))
    return C.temporal(said.union(orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"))), "id", ["start_date"])


@query("conflict_relations", "WITH r AS (SELECT o_custkey AS id, o_orderstatus AS type, o_orderpriority AS properties, CASE WHEN o_totalprice > 1000 THEN '0.8' ELSE '0.7' END AS confidence FROM orders), s AS (SELECT id, 'type' AS property, type AS v FROM r UNION ALL SELECT id, 'properties', properties FROM r UNION ALL SELECT id, 'confidence', confidence FROM r) SELECT id, property, count(DISTINCT v) AS n, 0.8::DOUBLE AS confidence, 'medium' AS severity FROM s GROUP BY 1, 2 HAVING count(DISTINCT v) > 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("properties"), F.when(F.col("o_totalprice") > 1000, "0.8").otherwise("0.7").alias("confidence"))
    return C.relations(o, "id", ["type", "properties", "confidence"])


_TYPES = "SELECT DISTINCT 'n' || c_nationkey || '-' || c_custkey // 4 AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Person' WHEN 'AUTOMOBILE' THEN 'Organization' WHEN 'MACHINERY' THEN 'Company' ELSE 'Location' END AS type FROM customer"


@query("conflict_logical", f"WITH t AS ({_TYPES}), x(a, b) AS (VALUES ('Person', 'Organization'), ('Person', 'Company'), ('Person', 'Institution'), ('Organization', 'Person'), ('Company', 'Person'), ('Location', 'Person'), ('Location', 'Organization')) SELECT u.id, u.type AS a, v.type AS b FROM t u JOIN t v ON u.id = v.id JOIN x ON x.a = u.type AND x.b = v.type")
def _(spark, sf):
    """Entities (four customers each) of types that exclude each other."""
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "Person").when(segment == "AUTOMOBILE", "Organization").when(segment == "MACHINERY", "Company").otherwise("Location")
    name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_custkey") / 4).cast("string"))
    return C.logical(table(spark, sf, "customer").select(name.alias("id"), kind.alias("type")))


@query("conflict_guides", "WITH r AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) SELECT id, 'Conflict of o_orderstatus on ' || id || ': ' || n || ' values. 1. Compare the sources. 2. Check the latest. 3. Record the choice.' AS guide FROM r WHERE n > 1")
def _(spark, sf):
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.countDistinct("o_orderstatus").alias("n")).where("n > 1")
    return found.select("id", C.guide(F.lit("o_orderstatus"), F.col("id").cast("string"), F.col("n")).alias("guide"))


# ---- chunks -----------------------------------------------------------------------------

_CUT = "coalesce(" + ", ".join(f"CASE WHEN contains(w, {s}) AND length(w) - length({s}) - (instr(reverse(w), reverse({s})) - 1) > 200 THEN length(w) - (instr(reverse(w), reverse({s})) - 1) END" for s in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")) + ", 400)"


@query("chunk_recursive", f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS start, substr(text, 1, 400) AS w, NULL::BIGINT AS cut, NULL::BIGINT AS before FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, substr(text, n + 1, 400), e, start FROM (SELECT *, start + {_CUT} AS e, greatest(start + 1, start + {_CUT} - 80) AS n FROM (SELECT * EXCLUDE (cut, before) FROM c WHERE start + 400 < length(text))) WHERE n < length(text)),
k AS (SELECT doc_id, text, start, CASE WHEN start + 400 >= length(text) THEN length(text) ELSE start + {_CUT} END AS stop FROM c)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, md5(chunk) AS digest FROM (SELECT *, CASE WHEN stop = length(text) THEN substr(text, start + 1) ELSE regexp_replace(substr(text, start + 1, stop - start), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') END AS chunk FROM k) WHERE chunk <> ''""")
def _(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.explode(X.recursive_chunks(F.col("text"), 400, 80)).alias("c"))
    return cut.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("stop"), F.md5("c.chunk").alias("digest"))


def _packing(parts, size, glue, most):
    limit = f" OR n >= {most}" if most else ""
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {parts} AS p FROM documents),
    r AS (SELECT doc_id, p, 1 AS k, 1 AS n, p[1] AS chunk, 1 AS c FROM s WHERE len(p) > 0
      UNION ALL SELECT doc_id, p, k + 1, CASE WHEN f THEN 1 ELSE n + 1 END, CASE WHEN f THEN p[k + 1] ELSE chunk || {glue} || p[k + 1] END, CASE WHEN f THEN c + 1 ELSE c END
      FROM (SELECT *, length(chunk) + length({glue}) + length(p[k + 1]) > {size}{limit} AS f FROM r WHERE k < len(p))),
    l AS (SELECT doc_id, c, max(n) AS n, arg_max(chunk, k) AS chunk FROM r GROUP BY 1, 2)
    SELECT doc_id, CAST(c - 1 AS INTEGER) AS chunk, CAST(n AS INTEGER) AS parts, md5(chunk) AS digest FROM l"""


def _numbered(docs, chunks):
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.n").alias("parts"), F.md5("c.chunk").alias("digest"))


@query("chunk_sentences", _packing(r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')", 500, "' '", 5))
def _(spark, sf):
    return _numbered(table(spark, sf, "documents"), X.packed(X.sentences(F.col("text")), 500, " ", most=5))


@query("chunk_paragraphs", _packing("list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')", 1500, "chr(10) || chr(10)", None))
def _(spark, sf):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return _numbered(table(spark, sf, "documents"), X.packed(parts, 1500, "\n\n"))


@query("chunk_sections", "SELECT page_id, CAST(k - 1 AS INTEGER) AS section, md5(s) AS digest FROM (SELECT page_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM (SELECT page_id, list_filter(string_split(regexp_replace(html, '(<(h[1-6]|p|table|ul)[ >])', chr(1) || '\\1', 'g'), chr(1)), lambda s: s <> '') AS p FROM pages))")
def _(spark, sf):
    """Pages cut before headings, paragraphs, tables and lists."""
    cut = X.sections(F.col("html"), "<(?:h[1-6]|p|table|ul)[ >]")
    return table(spark, sf, "pages").select("page_id", F.posexplode(cut).alias("section", "s")).select("page_id", "section", F.md5("s").alias("digest"))


@query("chunk_nested", "WITH p AS (SELECT doc_id, text, unnest(range(greatest(ceil(length(text) / 1000)::INT, 1))) AS p FROM documents), c AS (SELECT doc_id, p, substr(text, p * 1000 + 1, 1000) AS t FROM p), k AS (SELECT doc_id, p, t, unnest(range(greatest(ceil(length(t) / 300)::INT, 1))) AS c FROM c) SELECT doc_id, CAST(p AS INTEGER) AS parent, CAST(c AS INTEGER) AS child, md5(substr(t, c * 300 + 1, 300)) AS digest FROM k")
def _(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.explode(X.nested_chunks(F.col("text"), 1000, 300)).alias("c"))
    return cut.select("doc_id", "c.parent", "c.child", F.md5("c.chunk").alias("digest"))


# ---- extraction from statements that tell rows of the tables ------------------------------


def _statements(spark, sf):
    """One sentence or two for each customer."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    employer = F.concat(F.lit("Firm"), (F.col("c_custkey") % 9).cast("string"))
    text = F.concat("c_name", F.lit(" is located in "), "n_name", F.lit(". "), "c_name", F.lit(" works for "), employer, F.lit(", paid $"), F.format_string("%.2f", F.abs("c_acctbal")), F.lit(". "), "c_name", F.lit(" bought "), employer, F.lit(" on 1998-0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("-11."))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", text.alias("text"))


_NAME = "(?:Customer#[0-9]+|NATION_[0-9]+|Firm[0-9]+)"


@query("extract_relations", "SELECT c_custkey, c_name AS subject, 'located_in' AS relation, n_name AS object FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, c_name, 'works_for', 'Firm' || c_custkey % 9 FROM customer")
def _(spark, sf):
    return _statements(spark, sf).select("c_custkey", F.explode(X.relations(F.col("text"), _NAME)).alias("r")).select("c_custkey", "r.*")


@query("extract_triples", "SELECT '<urn:e:' || c_name || '> <urn:r:located_in> <urn:e:' || n_name || '> .' AS line FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT '<urn:e:' || c_name || '> <urn:r:works_for> <urn:e:Firm' || c_custkey % 9 || '> .' FROM customer")
def _(spark, sf):
    r = _statements(spark, sf).select(F.explode(X.relations(F.col("text"), _NAME)).alias("r"))
    return r.select(F.format_string("<urn:e:%s> <urn:r:%s> <urn:e:%s> .", "r.subject", "r.relation", "r.object").alias("line")).distinct()


@query("extract_entities", "SELECT c_custkey, 'MONEY' AS label, '$' || printf('%.2f', abs(c_acctbal)) AS entity FROM customer UNION ALL SELECT c_custkey, 'DATE', '1998-0' || c_custkey % 9 + 1 || '-11' FROM customer")
def _(spark, sf):
    """Entities of the general patterns that are told with a confidence of 0.7 or more."""
    found = _statements(spark, sf).select("c_custkey", F.explode(X.entities(F.col("text"))).alias("e")).where("e.confidence >= 0.7")
    return found.select("c_custkey", "e.label", "e.entity")


@query("extract_entities_confident", "SELECT c_custkey, '$' || printf('%.2f', abs(c_acctbal)) AS entity FROM customer")
def _(spark, sf):
    found = _statements(spark, sf).select("c_custkey", F.explode(X.entities(F.col("text"))).alias("e"))
    return found.where("e.confidence >= 0.72").select("c_custkey", "e.entity")


@query("extract_events", "SELECT c_custkey, 'acquisition' AS event, 'bought' AS trigger FROM customer")
def _(spark, sf):
    return _statements(spark, sf).select("c_custkey", F.explode(X.events(F.col("text"))).alias("e")).select("c_custkey", "e.*")


@query("extract_event_links", "SELECT 'Firm' || c_custkey % 9 AS participant, min(c_custkey) AS first, c.c_custkey FROM customer c JOIN (SELECT 'Firm' || c_custkey % 9 AS f, min(c_custkey) AS m FROM customer GROUP BY 1) ON f = 'Firm' || c.c_custkey % 9 WHERE c.c_custkey <> m GROUP BY 1, 3".replace("min(c_custkey) AS first, c.c_custkey", "min(m) AS first, c.c_custkey"))
def _(spark, sf):
    """Events that share a participant, tied to the first of them (a star, not all pairs)."""
    e = _statements(spark, sf).where(F.size(X.events(F.col("text"))) > 0).select("c_custkey", F.regexp_extract("text", r"bought (Firm[0-9]+)", 1).alias("participant"))
    first = e.groupBy("participant").agg(F.min("c_custkey").alias("first"))
    return e.join(first, "participant").where("c_custkey <> first").select("participant", "first", "c_custkey")


@query("extract_roles", "SELECT c_custkey, c_name AS agent, 'bought' AS predicate, 'Firm' || c_custkey % 9 AS theme, '1998-0' || c_custkey % 9 + 1 || '-11' AS time FROM customer")
def _(spark, sf):
    """Who did what to whom and when, of each statement of buying."""
    whole = rf"({_NAME}) (bought) ({_NAME}) on ([0-9-]+)"
    return _statements(spark, sf).select("c_custkey", *[F.regexp_extract("text", whole, k).alias(n) for k, n in enumerate(("agent", "predicate", "theme", "time"), 1)])


@query("extract_network", "WITH r AS (SELECT c_name AS s, n_name AS o FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_name, 'Firm' || c_custkey % 9 FROM customer) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT s AS node, 1 AS o, 0 AS i FROM r UNION ALL SELECT o, 0, 1 FROM r) GROUP BY node")
def _(spark, sf):
    r = _statements(spark, sf).select(F.explode(X.relations(F.col("text"), _NAME)).alias("r")).select("r.*")
    ends = r.select(F.explode(F.array(F.struct(F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


@query("extract_validity", "SELECT c_mktsegment AS segment, 2 * count(*) AS entities, 0 AS missing, round(0.725, 6) AS confidence FROM customer GROUP BY 1")
def _(spark, sf):
    """Extracted entities by segment: how many, how many without a text, mean confidence."""
    e = _statements(spark, sf).select("c_mktsegment", F.explode(X.entities(F.col("text"))).alias("e"))
    return e.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("entities"), F.count_if(F.trim("e.entity") == "").cast("int").alias("missing"), F.round(F.avg("e.confidence"), 6).alias("confidence"))


@query("extract_matches", "SELECT p_partkey, round(CASE WHEN p_name = 'cold widget' THEN 1.0 WHEN contains(' ' || p_name || ' ', ' cold ') OR contains(' ' || p_name || ' ', ' widget ') THEN 0 ELSE 0 END, 6) AS whole, round(CASE WHEN contains(' ' || p_name || ' ', ' widget ') THEN greatest(0.9 * 6 / length(p_name) + 0.1, 0.88) ELSE 0 END, 6) AS part FROM part")
def _(spark, sf):
    """How well part names are named by a whole text and by a word."""
    n = F.col("p_name")
    whole = F.when(X.matched(n, F.lit("cold widget")) == 1, 1.0).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", F.round(whole, 6).alias("whole"), F.round(X.matched(n, F.lit("widget")), 6).alias("part"))


@query("coreferences", "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS antecedent FROM conversations")
def _(spark, sf):
    """The turn that a reply refers to: the nearest one before it that is of the user."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("antecedent"))


@query("chunk_whole_entities", r"""WITH RECURSIVE s AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g') AS t FROM pages),
c AS (SELECT page_id, t, 0 AS start, least(200 + coalesce(length(regexp_extract(substr(t, 201), '^[A-Za-z]+')) * (CASE WHEN regexp_matches(substr(t, 200, 1), '[A-Za-z]') THEN 1 ELSE 0 END), 0), length(t)) AS stop FROM s WHERE length(t) > 0
UNION ALL SELECT page_id, t, stop, least(stop + 200 + coalesce(length(regexp_extract(substr(t, stop + 201), '^[A-Za-z]+')) * (CASE WHEN regexp_matches(substr(t, stop + 200, 1), '[A-Za-z]') THEN 1 ELSE 0 END), 0), length(t)) FROM c WHERE stop < length(t))
SELECT page_id, CAST(start AS INTEGER) AS start, md5(substr(t, start + 1, stop - start)) AS digest FROM c""")
def _(spark, sf):
    """Page texts in windows that never cut a run of letters (each an entity here)."""
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " ")
    cut = table(spark, sf, "pages").select("page_id", F.explode(X.whole_entity_chunks(text, 200, "[A-Za-z]+")).alias("c"))
    return cut.select("page_id", F.col("c.start").alias("start"), F.md5("c.chunk").alias("digest"))
