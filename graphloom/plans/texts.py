"""Mentions, relations and a graph taken from whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import mentions as M
from graphloom.sources.tables import table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


KINDS = {"name": "[A-Z][a-z]{2,}", "number": "[0-9]{4,}"}
TYPES = ("of the", "with", "que la", "license version")
_SPACE = r"[ \t\n\r\f\x0B]"


def _mentions_sql(rows: str, key: str, text: str) -> str:
    """k: key, label, e, start, stop of all kinds, of rows (key, text)."""
    one = "SELECT {key}, '{label}' AS label, e, stop - length(e) AS start, stop FROM (SELECT {key}, e, sum(length(g) + length(e)) OVER (PARTITION BY {key} ORDER BY k) AS stop FROM (SELECT {key}, unnest(e) AS e, unnest(g[1:len(e)]) AS g, generate_subscripts(e, 1) AS k FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS e, regexp_split_to_array({text}, '{p}') AS g FROM {rows})))"
    return " UNION ALL ".join(one.format(rows=rows, key=key, text=text, label=label, p=p) for label, p in KINDS.items())


def _trimmed_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query("extract_mentions", f"WITH m AS ({_mentions_sql('documents', 'doc_id', 'text')}) SELECT m.doc_id, label, e AS entity, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, md5(substr(text, stop::BIGINT + 1, 100)) AS after FROM m JOIN documents d ON d.doc_id = m.doc_id")
def _(spark, sf):
    """Where names and numbers stand in each document, and what follows them."""
    out = M.mentions(table(spark, sf, "documents"), key="doc_id", patterns=KINDS)
    return out.select("doc_id", "label", "entity", "start", "stop", F.md5("after").alias("after"))


_WORDS = f"list_distinct(list_filter(regexp_split_to_array(lower({{}}), '{_SPACE}+'), lambda x: x <> ''))"
_TYPES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TYPES))


@query("extract_relations_by_context", f"""WITH m AS ({_mentions_sql('documents', 'doc_id', 'text')}),
p AS (SELECT l.doc_id, l.e AS le, r.e AS re, l.start AS ls, r.start AS rs, r.stop AS rt, {_trimmed_sql('substr(d.text, l.stop::BIGINT + 1, (r.start - l.stop)::BIGINT)')} AS between_
  FROM m l JOIN m r ON l.doc_id = r.doc_id AND r.start >= l.stop AND r.start <= l.stop + 100 JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT p.*, t.k, t.name, CASE WHEN contains(lower(between_), t.name) THEN 1.0::DOUBLE ELSE len(list_intersect({_WORDS.format('between_')}, {_WORDS.format('t.name')}))::DOUBLE / len(list_distinct(list_concat({_WORDS.format('between_')}, {_WORDS.format('t.name')}))) END AS score FROM p, (VALUES {_TYPES}) t(k, name) WHERE between_ <> ''),
b AS (SELECT doc_id, le, re, ls, rs, any_value(rt) AS rt, arg_max(name, score - k / 1e9) AS relation, max(score) AS score FROM s GROUP BY ALL HAVING max(score) >= 0.3)
SELECT doc_id, le AS subject, relation, re AS object, round(score, 9) AS score, CAST(ls AS INTEGER) AS subject_start, CAST(rs AS INTEGER) AS object_start FROM b
UNION ALL SELECT doc_id, re, relation, le, round(score, 9), CAST(rs AS INTEGER), CAST(ls AS INTEGER) FROM b WHERE rt - ls <= 100""")
def _(spark, sf):
    """Two names or numbers near each other, related by the words between them."""
    found = M.mentions(table(spark, sf, "documents"), key="doc_id", patterns=KINDS)
    out = M.related_by_context(found, TYPES, key="doc_id", threshold=0.3, measure="words")
    return out.drop("between").withColumn("score", F.round("score", 9))


@query("extract_relations_by_sequence")
def _(spark, sf):
    """The same by matching blocks of characters; SQL has no such measure."""
    found = M.mentions(table(spark, sf, "documents"), key="doc_id", patterns=KINDS)
    return M.related_by_context(found, TYPES, key="doc_id").drop("between")


_OF, _WITH = " (?:of the|of) ", " (?:with the|with) "


@query("extract_relations_inverse", f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]{{4,}}){_OF}([a-z]{{4,}})', 1)) AS subject, unnest(regexp_extract_all(text, '([a-z]{{4,}}){_OF}([a-z]{{4,}})', 2)) AS object FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]{{4,}}){_WITH}([a-z]{{4,}})', 2)), unnest(regexp_extract_all(text, '([a-z]{{4,}}){_WITH}([a-z]{{4,}})', 1)) FROM documents)
SELECT doc_id, subject, 'part_of' AS relation, object, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    """x of y and y with x both tell that x is part of y."""
    told = X.relations(F.col("text"), "[a-z]{4,}", {"part_of": _OF}, {"part_of": _WITH})
    rows = table(spark, sf, "documents").select("doc_id", F.explode(told).alias("r")).select("doc_id", "r.*")
    return rows.groupBy("doc_id", "subject", "relation", "object").agg(F.count("*").alias("n"))


_CHUNKS = f"""d AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array({_trimmed_sql('text')}, '\\n{_SPACE}*\\n'), lambda x: {_trimmed_sql('x')}), lambda x: x <> ''), lambda x: list_transform(range(0, length(x), 1200), lambda i: substr(x, i + 1, 1200)))) AS ps FROM documents),
w AS (SELECT doc_id, ps, 1 AS k, ps[1] AS chunk, 0 AS n FROM d WHERE len(ps) > 0 UNION ALL SELECT doc_id, ps, k + 1, CASE WHEN length(chunk) + 2 + length(ps[k + 1]) > 1200 THEN ps[k + 1] ELSE chunk || chr(10) || chr(10) || ps[k + 1] END, n + CASE WHEN length(chunk) + 2 + length(ps[k + 1]) > 1200 THEN 1 ELSE 0 END FROM w WHERE k < len(ps)),
c AS (SELECT doc_id * 100000 + n AS place, doc_id || '#' || n AS source, arg_max(chunk, k) AS chunk FROM w GROUP BY doc_id, n),
m AS ({_mentions_sql('c', 'place', 'chunk')}),
e AS (SELECT m.place, m.start, m.stop, m.label, m.e AS name, lower(m.e) AS entity, c.source, c.chunk, {_trimmed_sql('substr(c.chunk, m.stop::BIGINT + 1, 100)')} AS description FROM m JOIN c ON c.place = m.place)"""


def _taken(spark, sf):
    docs = table(spark, sf, "documents")
    return M.taken_up(M.extracted(docs, key="doc_id", patterns=KINDS), key="doc_id")


@query("graph_ingested_entities", f"""WITH RECURSIVE {_CHUNKS}
SELECT entity, arg_min(name, (place * 10000 + start)::BIGINT) AS name, arg_min(label, (place * 10000 + start)::BIGINT) AS type, md5(arg_min(description, ((100 - length(description)) * 10000000000000000 + place * 10000 + start)::BIGINT)) AS description, count(DISTINCT source) AS sources FROM e GROUP BY entity""")
def _(spark, sf):
    """A graph of all documents' names and numbers, by chunks: entities and their sources."""
    g = _taken(spark, sf)
    n = g.entity_sources.groupBy("entity").agg(F.count("*").alias("sources"))
    return g.entities.join(n, "entity").select("entity", "name", "type", F.md5("description").alias("description"), "sources")


@query("graph_ingested_relations", f"""WITH RECURSIVE {_CHUNKS},
l AS (SELECT place, start, source, entity AS src, lead(entity) OVER v AS dst, lead(start) OVER v - stop AS gap, chunk, stop FROM e WINDOW v AS (PARTITION BY place ORDER BY start)),
r AS (SELECT *, {_trimmed_sql('substr(chunk, stop::BIGINT + 1, gap::BIGINT)')} AS description FROM l WHERE dst <> src AND gap BETWEEN 0 AND 100)
SELECT src, dst, md5(arg_min(description, ((100 - length(description)) * 10000000000000000 + place * 10000 + start)::BIGINT)) AS description, count(DISTINCT source) AS sources FROM r GROUP BY src, dst""")
def _(spark, sf):
    """The same graph's relations between names that follow each other in a chunk."""
    g = _taken(spark, sf)
    n = g.relation_sources.groupBy("src", "dst").agg(F.count("*").alias("sources"))
    return g.relations.join(n, ["src", "dst"]).select("src", "dst", F.md5("description").alias("description"), "sources")
