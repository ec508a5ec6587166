"""Versions, RDF files and the matching stream, against what they were made from."""

from __future__ import annotations

import glob
import itertools
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dedup as DD
from graphloom.operators.version_store import VersionStore
from graphloom.sources import rdf, writers
from graphloom.streaming import matching as MT

ROWS = "id long, name string, n int"


def state(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_each_version_is_restored(spark, tmp_path):
    rnd = random.Random(2)
    made = lambda rows: spark.createDataFrame(rows, ROWS)
    store = VersionStore(spark, f"{tmp_path}/s", "id", made([]).schema)
    assert store.log().count() == 0 and store.verified() == []
    now, states = {}, []
    for version in range(1, 6):
        for k in rnd.sample(range(30), 12):
            if rnd.random() < 0.3:
                now.pop(k, None)
            else:
                now[k] = (k, rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]))
        if version == 4:
            gone = [k for k in list(now)[:3]]
            put = {100 + k: (100 + k, "new", None) for k in range(3)}
            before = dict(zip((r[0] for r in states[-1]), states[-1], strict=True))
            now = {k: v for k, v in before.items() if k not in gone} | put
            store.changed(made(list(put.values())), "four", drops=spark.createDataFrame([(k,) for k in gone], "id long"))
        else:
            assert store.commit(made(list(now.values())), f"v{version}", author="me") == version
        states.append(sorted(now.values(), key=str))
        if version == 3:
            store.compact(3)
    for version, want in enumerate(states, 1):
        assert state(store.restored(version)) == want
    assert store.commit(made(states[-1]), "same") == 6
    assert store.log().where("version = 6").select("puts", "drops").first() == (0, 0)
    store.tag(2, "good")
    assert store.version_of("good") == 2 and store.version_of("v3") == 3
    with pytest.raises(KeyError):
        store.version_of("bad")
    with pytest.raises(KeyError):
        store.restored(99)
    assert store.verified() == [(k, True) for k in range(1, 7)]
    key = states[0][0][0]
    changes = store.history(key).orderBy("version").collect()
    assert changes[0].version == 1 and changes[0].row.id == key
    # a delta that is changed later is found, from its version on
    shutil.rmtree(f"{tmp_path}/s/delta/version=3")
    made([(1, "forged", 1)]).withColumn("op", F.lit("put")).write.parquet(f"{tmp_path}/s/delta/version=3")
    assert store.verified() == [(k, k < 3) for k in range(1, 7)]


def test_an_interrupted_version_is_not_there(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, ROWS)
    store = VersionStore(spark, f"{tmp_path}/s", "id", made([]).schema)
    store.commit(made([(1, "a", 1)]), "one")
    made([(1, "half", 1)]).withColumn("op", F.lit("put")).write.parquet(f"{tmp_path}/s/delta/version=2")
    assert store.history(1).count() == 1
    assert store.commit(made([(1, "b", 2)]), "two") == 2
    assert state(store.restored(2)) == [(1, "b", 2)] and store.verified() == [(1, True), (2, True)]


TURTLE = '''@prefix ex: <http://e/> . # a comment
PREFIX f: <http://f/>
@base <http://base/dir/> .
ex:a a ex:Thing ; ex:name "A \\"q\\" \\u00e9"@en-GB , """long
"text" \\\\""" ; ex:size 5, -2.5, 1e3 , true ; .
<rel> ex:knows [ ex:name 'b' ; ex:of _:x ] .
_:x ex:list ( 1 ex:a "c"^^f:t ) .
_:x ex:none () .
[ ex:p ex:q ] .
ex:dot.ted ex:p <http://z/#frag> .
'''


def test_turtle(spark, tmp_path):
    rdf_, xsd = rdf.RDF, rdf.XSD
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.ttl").write_text("")
    rows = rdf.read_rdf(spark, str(tmp_path), "turtle").collect()
    got = {tuple(r) for r in rows}
    blanks = {r.o for r in rows if r.kind == "blank"} | {r.s for r in rows if r.s[:2] == "_:"}
    x = next(b for b in blanks if b.endswith(".x"))
    assert {("http://e/a", rdf_ + "type", "http://e/Thing", "iri", None, None), ("http://e/a", "http://e/name", 'A "q" é', "literal", "en-GB", None), ("http://e/a", "http://e/name", 'long\n"text" \\', "literal", None, None)} <= got
    assert {(r.o, r.datatype) for r in rows if r.p == "http://e/size"} == {("5", xsd + "integer"), ("-2.5", xsd + "decimal"), ("1e3", xsd + "double"), ("true", xsd + "boolean")}
    inner = next(r.o for r in rows if r.s == "http://base/dir/rel")
    assert (inner, "http://e/name", "b", "literal", None, None) in got and (inner, "http://e/of", x, "blank", None, None) in got
    cell, items = next(r.o for r in rows if r.p == "http://e/list"), []
    while cell != rdf_ + "nil":
        items.append(next((r.o, r.datatype) for r in rows if r.s == cell and r.p == rdf_ + "first"))
        cell = next(r.o for r in rows if r.s == cell and r.p == rdf_ + "rest")
    assert items == [("1", xsd + "integer"), ("http://e/a", None), ("c", "http://f/t")]
    assert (x, "http://e/none", rdf_ + "nil", "iri", None, None) in got
    assert ("http://e/dot.ted", "http://e/p", "http://z/#frag", "iri", None, None) in got and len(got) == 20


XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/" xml:base="http://base/" xml:lang="en">
 <ex:Person rdf:about="p1" ex:nick="n"><ex:name>A &amp; B</ex:name><ex:age rdf:datatype="http://d/int">5</ex:age>
  <ex:knows rdf:resource="#p2"/><ex:owns><rdf:Description rdf:ID="car"><ex:wheels xml:lang="de">vier</ex:wheels></rdf:Description></ex:owns>
  <ex:home rdf:parseType="Resource"><ex:city>C</ex:city></ex:home></ex:Person>
 <rdf:Bag rdf:nodeID="b"><rdf:li>x</rdf:li><rdf:li>y</rdf:li></rdf:Bag>
 <rdf:Description rdf:about="http://l"><ex:all rdf:parseType="Collection"><rdf:Description rdf:about="i1"/><rdf:Description rdf:about="i2"/></ex:all></rdf:Description>
</rdf:RDF>"""


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(XML)
    rows = rdf.read_rdf(spark, str(tmp_path), "rdf_xml").collect()
    got, e, t = {tuple(r) for r in rows}, "http://e/", rdf.RDF
    p = "http://base/p1"
    assert {
        (p, t + "type", e + "Person", "iri", None, None), (p, e + "nick", "n", "literal", "en", None), (p, e + "name", "A & B", "literal", "en", None), (p, e + "age", "5", "literal", None, "http://d/int"),
        (p, e + "knows", "http://base/#p2", "iri", None, None), (p, e + "owns", "http://base/#car", "iri", None, None), ("http://base/#car", e + "wheels", "vier", "literal", "de", None),
    } <= got
    home = next(r.o for r in rows if r.p == e + "home")
    assert (home, e + "city", "C", "literal", "en", None) in got
    assert {(r.p, r.o) for r in rows if r.s.endswith(".b")} == {(t + "type", t + "Bag"), (t + "_1", "x"), (t + "_2", "y")}
    cell, items = next(r.o for r in rows if r.p == e + "all"), []
    while cell != t + "nil":
        items.append(next(r.o for r in rows if r.s == cell and r.p == t + "first"))
        cell = next(r.o for r in rows if r.s == cell and r.p == t + "rest")
    assert items == ["http://base/i1", "http://base/i2"]


def test_what_was_written_comes_back(spark, tmp_path):
    values = ['plain', 'a "quote" \\ slash', "line\nend\r", "<tag> & é 😀", ";.,[]"]
    facts = spark.createDataFrame([(f"s{k % 3}", f"p{k}", v) for k, v in enumerate(values)], "s string, p string, o string")
    want = sorted((f"urn:x:s{k % 3}", f"urn:x:p{k}", v) for k, v in enumerate(values))
    writers.turtle(facts, "urn:x:").write.text(f"{tmp_path}/t")
    writers.ntriples(facts, "urn:x:").write.text(f"{tmp_path}/n")
    for folder in "tn":
        assert state(rdf.read_rdf(spark, f"{tmp_path}/{folder}", "turtle").select("s", "p", "o")) == want
    rows = spark.createDataFrame([(f"k{k}", v) for k, v in enumerate(values) if "\r" not in v], "id string, label string")
    writers.rdf_documents(writers.rdf_xml(rows, "id", ["label"], "urn:x:"), {"x": "urn:x:"}, rows=2).write.option("maxRecordsPerFile", 1).text(f"{tmp_path}/x")
    assert len(glob.glob(f"{tmp_path}/x/part-*")) > 1
    assert state(rdf.read_rdf(spark, f"{tmp_path}/x", "rdf_xml").select("s", "p", "o")) == sorted((f"urn:x:k{k}", "urn:x:label", v) for k, v in enumerate(values) if "\r" not in v)


def test_what_is_no_rdf_is_an_error(spark, tmp_path):
    (tmp_path / "bad.ttl").write_text("ex:a ex:b ex:c .")
    with pytest.raises(Exception, match=r"bad.ttl: the prefix ex: is not known"):
        rdf.read_rdf(spark, str(tmp_path), "turtle").count()
    with pytest.raises(ValueError, match="unknown form"):
        rdf.read_rdf(spark, str(tmp_path), "json")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - levenshtein(a, b) / max(len(a), len(b))


def people(n, seed=3):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(["anna", "anne", "hanna", "berta", "bert"]) + rnd.choice(["", "x", "yy"]) for _ in range(2)), float(k * 10)) for k in range(n)]


KEYS = lambda n: F.transform(F.split(n, " "), lambda w: F.left(w, F.lit(2)))


@pytest.mark.parametrize("keep", [None, 200.0])
def test_stream_of_matches_with_a_restart(spark, tmp_path, keep):
    rows = people(60)
    source, state_, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    made = lambda part: spark.createDataFrame(part, "id long, name string, at double").coalesce(1)

    def drain():
        stream = spark.readStream.schema("id long, name string, at double").parquet(source)
        pairs = MT.matched(stream, 0.7, key="id", name="name", blocks=KEYS, at=F.col("at"), keep=keep, late=0.0, parts=3)
        query = pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", state_).trigger(availableNow=True).start()
        query.awaitTermination()

    made(rows[:25]).write.mode("append").parquet(source)
    drain()
    shutil.copytree(state_, tempfile.mkdtemp(prefix="spark-") + "/kept")
    made(rows[25:26]).write.mode("append").parquet(source)
    made(rows[26:]).write.mode("append").parquet(source)
    drain()
    drain()  # nothing new
    got = {(r.a, r.b): r.score for r in spark.read.parquet(out).collect()}
    blocks = {i: {w[:2] for w in name.split(" ")} for i, name, _ in rows}
    want = {(a[0], b[0]): s for a, b in itertools.combinations(rows, 2) if blocks[a[0]] & blocks[b[0]] and (keep is None or b[2] - a[2] <= keep) and (s := alike(a[1], b[1])) >= 0.7}
    assert got == pytest.approx(want) and len(want) > 20
    assert spark.read.parquet(out).count() == len(want)


def test_incremental_takes_the_best_known_name(spark):
    rows = people(80, seed=9)
    new, known = rows[:20], rows[20:] + [(200, rows[0][1], 0.0)]
    frame = lambda part: spark.createDataFrame(part, "id long, name string, at double")
    got = {r.id: (r.match, r.score) for r in DD.incremental(frame(new), frame(known), 0.8, key="id", name="name", blocks=KEYS).collect()}
    for i, name, _ in new:
        near = [(-alike(name, other), k) for k, other, _ in known if {w[:2] for w in name.split(" ")} & {w[:2] for w in other.split(" ")} and alike(name, other) >= 0.8]
        best = min(near, default=None)
        assert got[i] == ((None, None) if best is None else (best[1], pytest.approx(-best[0])))
