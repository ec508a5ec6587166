"""Mentions, relations by context and the growing graph against plain Python."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import mentions as M

KINDS = {"name": "[A-Z][a-z]{2,}", "number": "[0-9]{4,}"}
SCHEMA = "doc_id long, text string"


def placed(text):
    out = [(m.start(), m.end(), label, m.group()) for label, p in KINDS.items() for m in re.finditer(p, text or "")]
    return sorted(out)


def texts(seed, n=30):
    rnd = random.Random(seed)
    words = ["Alan", "Berta", "Cilia", "4711", "2024", "works", "for", "founded", "in", "é😀", "Éva", "\n", "\n\n", "", " ", "was", "born", "Paris"]
    return [None, "", "Alan", "no one", "AlanBerta 4711", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(n)]]


def test_places_equal_python(spark):
    rows = list(enumerate(texts(1) + ["Alan " * 3000, "x" * 50_000 + "Berta"]))
    got = M.mentions(spark.createDataFrame(rows, SCHEMA), key="doc_id", patterns=KINDS, reach=17).collect()
    want = {(d, *m, (t or "")[m[1] : m[1] + 17]) for d, t in rows for m in placed(t)}
    assert len(got) == len(want) and {(r.doc_id, r.start, r.stop, r.label, r.entity, r.after) for r in got} == want


def related(rows, types, reach, threshold):
    out = []
    for d, t in rows:
        ms = placed(t)
        for a in ms:
            for b in ms:
                if a == b or abs(a[1] - b[0]) > reach:
                    continue
                low, high = (a[1], b[0]) if a[1] < b[0] else (b[1], a[0])
                between = t[low:high].strip()
                best, top = None, 0.0
                for name in types if between else ():
                    score = 1.0 if name in between.lower() else difflib.SequenceMatcher(None, name, between.lower()).ratio()
                    if score > top:
                        best, top = name, score
                if best and top >= threshold:
                    out.append((d, a[3], best, b[3], round(top, 9), a[0], b[0]))
    return sorted(out)


@pytest.mark.parametrize("reach", [12, 100])
def test_relations_by_context_equal_all_pairs(spark, reach):
    rows, types = list(enumerate(texts(2))), ["works for", "founded", "born in", "was"]
    found = M.mentions(spark.createDataFrame(rows, SCHEMA), key="doc_id", patterns=KINDS, reach=reach)
    got = M.related_by_context(found, types, key="doc_id", reach=reach, threshold=0.5).collect()
    assert sorted((r.doc_id, r.subject, r.relation, r.object, round(r.score, 9), r.subject_start, r.object_start) for r in got) == related(rows, types, reach, 0.5) != []


def test_relation_types_are_needed(spark):
    found = M.mentions(spark.createDataFrame([], SCHEMA), key="doc_id", patterns=KINDS)
    with pytest.raises(ValueError):
        M.related_by_context(found, [], key="doc_id")
    with pytest.raises(ValueError):
        M.related_by_context(found, ["a"], key="doc_id", measure="guess")
    assert M.related_by_context(found, ["a"], key="doc_id").count() == 0


def test_inverse_forms(spark):
    rows = spark.createDataFrame([(1, "Acme was founded by Alan. Berta founded Bolt. Cern acquired Dyne. Dyne is owned by Cern.")], SCHEMA)
    got = rows.select(F.explode(X.relations(F.col("text"), "[A-Z][a-z]+", inverse=X.INVERSE)).alias("r")).select("r.*").collect()
    assert sorted(map(tuple, got)) == [("Acme", "founded_by", "Alan"), ("Bolt", "founded_by", "Berta"), ("Dyne", "acquired_by", "Cern"), ("Dyne", "acquired_by", "Cern")]


def chunked(text, size):
    out, now = [], ""
    for p in (q.strip() for q in re.split(r"\n\s*\n", text.strip())):
        if not p:
            continue
        for piece in (p[k : k + size] for k in range(0, len(p), size)):
            if now and len(now) + 2 + len(piece) > size:
                out.append(now)
                now = piece
            else:
                now = f"{now}\n\n{piece}" if now else piece
    return out + [now] if now else out


def grown(rows, size, reach):
    entities, relations = {}, {}
    for d, t in rows:
        for n, chunk in enumerate(chunked(t or "", size)):
            source, ms = f"{d}#{n}", placed(chunk)
            for m in ms:
                told = chunk[m[1] : m[1] + reach].strip()
                e = entities.setdefault(m[3].lower(), [m[3], m[2], "", set()])
                e[2] = max(e[2], told, key=len)
                e[3].add(source)
            for a, b in zip(ms, ms[1:], strict=False):
                x, y = a[3].lower(), b[3].lower()
                if x != y and 0 <= b[0] - a[1] <= reach:
                    r = relations.setdefault((x, y), ["", set()])
                    r[0] = max(r[0], chunk[a[1] : b[0]].strip(), key=len)
                    r[1].add(source)
    return entities, relations


def held(graph):
    entities = {r.entity: [r["name"], r.type, r.description, set()] for r in graph.entities.collect()}
    relations = {(r.src, r.dst): [r.description, set()] for r in graph.relations.collect()}
    for r in graph.entity_sources.collect():
        entities[r.entity][3].add(r.source)
    for r in graph.relation_sources.collect():
        relations[r.src, r.dst][1].add(r.source)
    return entities, relations


def test_graph_grows_as_one_text_at_a_time(spark):
    rows = list(enumerate(texts(3, 24)))
    want = grown(rows, 90, 20)
    chunks = lambda some: M.extracted(spark.createDataFrame(some, SCHEMA), key="doc_id", patterns=KINDS, size=90, reach=20)
    assert held(M.taken_up(chunks(rows), key="doc_id")) == want
    first = M.taken_up(chunks(rows[:15]), key="doc_id")
    assert held(M.taken_up(chunks(rows[15:]), key="doc_id", known=first, batch=2)) == want
    again = M.taken_up(chunks(rows[15:]), key="doc_id", known=M.taken_up(chunks(rows), key="doc_id"), batch=2)
    assert held(again) == want


def test_relations_need_entities_known_by_then(spark):
    schema = "source string, doc_id long, n int, entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,description:string>>"
    rows = [
        ("1#0", 1, 0, [("Alan  T", "", None), (" ", "x", "gone")], [("alan t", "Berta", "too early"), ("ALAN T", "Alan T", "itself")]),
        ("2#0", 2, 0, [("Berta", "Person ", "b")], [("alan t", " berta", "knows"), ("Berta", "nobody", "never told")]),
        ("3#0", 3, 0, [], [("Alan T", "Berta", "knew")]),
        ("4#0", 4, 0, None, None),
    ]
    got = held(M.taken_up(spark.createDataFrame(rows, schema), key="doc_id"))
    assert got == ({"alan t": ["Alan  T", "concept", "", {"1#0"}], "berta": ["Berta", "person", "b", {"2#0"}]}, {("alan t", "berta"): ["knows", {"2#0", "3#0"}]})
