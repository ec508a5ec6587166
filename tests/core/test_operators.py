"""Operators on small literal tables with values worked out by hand or by brute force."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions import strings as S
from graphloom.functions import text as X
from graphloom.operators import conflicts as C
from graphloom.operators import graph as G
from graphloom.operators import rules as R
from graphloom.operators import temporal as T
from graphloom.operators import versions as V
from graphloom.operators.loops import components, reachable
from graphloom.plans.pipeline import Pipeline
from graphloom.sources import readers, writers


def edges(spark, pairs, weight=1.0):
    return spark.createDataFrame([(a, b, "t", weight) for a, b in pairs], "src string, dst string, type string, weight double")


PATH = [("A", "B"), ("B", "C"), ("C", "D"), ("A", "E")]


def test_degree_ranks_share_ties(spark):
    got = {r.node: (r.degree, r["rank"], round(r.centrality, 6)) for r in G.degree_centrality(edges(spark, PATH)).collect()}
    assert got == {"A": (2, 1, 0.5), "B": (2, 1, 0.5), "C": (2, 1, 0.5), "D": (1, 4, 0.25), "E": (1, 4, 0.25)}


def brute_betweenness(pairs):
    nodes = sorted({x for p in pairs for x in p})
    near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        best, found, queue = None, [], deque([[s]])
        while queue:
            p = queue.popleft()
            if best and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                found.append(p)
                continue
            queue.extend(p + [n] for n in near[p[-1]] if n not in p)
        for p in found:
            for n in p[1:-1]:
                total[n] += 1 / len(found)
    n = len(nodes)
    return {k: v * 2 / ((n - 1) * (n - 2)) for k, v in total.items()}


def test_betweenness(spark):
    rnd = random.Random(3)
    pairs = list({tuple(sorted(rnd.sample("abcdefgh", 2))) for _ in range(11)})
    got = {r.node: r.betweenness for r in G.betweenness(edges(spark, pairs)).collect()}
    assert got == pytest.approx(brute_betweenness(pairs))


def test_bridges(spark):
    rnd = random.Random(5)
    pairs = sorted({tuple(sorted(rnd.sample("abcdefghijkl", 2))) for _ in range(14)})

    def parts(ps):
        up = {x: x for p in pairs for x in p}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in ps:
            up[find(a)] = find(b)
        return len({find(x) for x in up})

    want = {p for p in pairs if parts([q for q in pairs if q != p]) > parts(pairs)}
    assert {(r.a, r.b) for r in G.bridges(edges(spark, pairs)).collect()} == want


def test_reach_and_paths(spark):
    e = edges(spark, PATH)
    got = {(r.node, r.hops) for r in reachable(e, spark.createDataFrame([("A",)], "start string")).collect()}
    assert got == {("A", 0), ("B", 1), ("E", 1), ("C", 2), ("D", 3)}
    assert [r.path for r in G.paths(e, "A", "D", max_hops=4).collect()] == ["A>B>C>D"]
    near = {r.node: (r.hop, r.band) for r in G.neighbors(e, "A", 3).collect()}
    assert near == {"B": (1, "direct"), "E": (1, "direct"), "C": (2, "near"), "D": (3, "near")}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_scores(spark):
    got = {(r.u, r.v): r for r in G.link_scores(edges(spark, [("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", "y")])).collect()}
    assert got["a", "b"].common_neighbors == 2 and got["a", "b"].jaccard == 1.0
    assert got["a", "c"].jaccard == 0.5 and got["x", "y"].preferential_attachment == 6


def test_two_validity_rules(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-10 00:00:00' AS a, timestamp_ntz'2024-01-20 00:00:00' AS b, timestamp_ntz'2024-01-20 00:00:00' AS t")
    half, closed = row.select(T.active_half_open(F.col("a"), F.col("b"), F.col("t")), T.active_closed(F.col("a"), F.col("b"), F.col("t"))).first()
    assert not half and closed


def test_allen_covers_all_relations(spark):
    points = list(itertools.combinations(range(1, 6), 2))
    data = [(a, b, c, d) for a, b in points for c, d in points]
    rows = spark.createDataFrame(data, "a1 int, a2 int, b1 int, b2 int").select(*[F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("a1", "a2", "b1", "b2")])
    seen = {r[0] for r in rows.select(T.allen(*[F.col(c) for c in ("a1", "a2", "b1", "b2")])).collect()}
    assert len(seen) == 13


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, l string")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, rt int, r string")
    assert {(r.l, r.r) for r in T.as_of(left, right, "k", "t", "rt").collect()} == {("x", "b"), ("y", None), ("z", None)}


def test_merge_gaps_coverage(spark):
    rows = spark.createDataFrame([("k", a, b) for a, b in [(0, 10), (10, 20), (30, 40), (32, 35)]], "k string, a int, b int").select("k", *[F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("a", "b")])
    low, high = (F.timestamp_seconds(F.lit(x)).cast("timestamp_ntz") for x in (0, 50))
    assert T.merged(rows, "k", "a", "b").count() == 2
    assert T.gaps(rows, "k", "a", "b", low, high).count() == 2
    assert T.coverage(rows, "k", "a", "b", low, high).first().coverage == pytest.approx(0.6)


def test_datalog_recursion_and_ground_goals(spark):
    facts = spark.createDataFrame([("parent", ["tom", "bob"]), ("parent", ["bob", "ann"]), ("parent", ["ann", "joe"])], "pred string, args array<string>")
    known = R.derived(facts, ["ancestor(X, Y) :- parent(X, Y).", "ancestor(X, Z) :- parent(X, Y), ancestor(Y, Z)."])
    assert R.answers(known, "ancestor(tom, Y)").count() == 3
    assert R.answers(known, "ancestor(tom, joe)").count() == 1 and R.answers(known, "ancestor(joe, tom)").count() == 0
    with pytest.raises(ValueError):
        R.parsed("nothing here")


def test_policy_and_conflicts(spark):
    row = spark.sql("SELECT 600 AS score, 'rejected' AS outcome")
    got = row.select(R.policy({"min_score": 650, "max_score": 900, "allowed_outcome": ["approved"], "required_name": True}, {"score": F.col("score"), "outcome": F.col("outcome")})).first()[0]
    assert got == ["min_score", "allowed_outcome", "required_name"]
    claims = spark.createDataFrame([("e", "p", "b", "s1", 0.9, 1, 0), ("e", "p", "a", "s2", 0.2, 2, 1), ("e", "p", "a", "s3", 0.2, 3, 2)], "entity string, property string, value string, source string, confidence double, ts int, pos int")
    want = {"voting": "a", "credibility_weighted": "b", "most_recent": "a", "first_seen": "b", "highest_confidence": "b"}
    assert {s: C.resolved(claims, s).first().value for s in want} == want


def test_compare_versions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {(r.k, r.change, r.fields) for r in V.compared(a, b, "k", ["v"]).collect()} == {(1, "removed", ""), (2, "modified", "v"), (4, "added", "")}


def test_text_functions(spark):
    row = spark.createDataFrame([("mail a.b@c.org at 10.0.0.1 card 4111111111111111", "<p>a &amp; <b>b</b></p><script>x</script>", "$1.5M", "my class name")], "t string, h string, n string, c string")
    got = row.select(X.masked(F.col("t")), X.without_tags(F.col("h")), X.number(F.col("n")), X.pascal_case(F.col("c")), X.camel_case(F.col("c")), F.size(S.bigrams(F.lit("abab")))).first()
    assert tuple(got) == ("mail [EMAIL] at [IP] card [NUMBER]", "a & b", 1.5e6, "MyClassName", "myClassName", 2)
    for n in (0, 1, 499, 500, 501, 900, 901):
        parts = spark.range(1).select(X.chunks(F.lit("x" * n), 500, 100)).first()[0]
        assert sum(len(p.chunk) for p in parts) - 100 * (len(parts) - 1) == n


def test_pipeline_orders_and_checks(spark):
    p = Pipeline().add("twice", lambda a: a.union(a), "source").add("count", lambda a: a.groupBy().count(), "twice")
    assert p.plans(source=spark.range(3))["count"].first()[0] == 6
    with pytest.raises(ValueError):
        Pipeline().add("a", lambda b: b, "b").add("b", lambda a: a, "a").order()
    with pytest.raises(ValueError):
        Pipeline().add("a", lambda b: b, "missing").order()


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "b.txt").write_text("hello")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.files(spark, str(tmp_path / "in"), content=True).collect()}
    assert kinds == {"a.pdf": "pdf", "b.txt": "txt"}
    facts = spark.createDataFrame([("s", "p", 'quote " and\nline')], "s string, p string, o string")
    line = writers.ntriples(facts, "urn:x:").first().value
    assert line == '<urn:x:s> <urn:x:p> "quote \\" and\\nline" .'
    writers.written(facts, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_duty_separation_golden_orders(spark):
    roles = spark.createDataFrame([("E091", "role:Manager"), ("E118", "role:Manager"), ("E140", "role:Director"), ("E207", "role:Analyst"), ("E312", "role:VP")], "employee string, role string")
    related = spark.createDataFrame([("V77", "E140")], "vendor string, employee string")
    orders = [("PO-2101", "V11", 4500.0, "E207", "E091", "E118"), ("PO-2204", "V11", 12000.0, "E207", "E118", "E118"), ("PO-2301", "V11", 9000.0, "E091", "E091", "E118"), ("PO-2317", "V11", 48750.0, "E207", "E091", "E312"), ("PO-2402", "V77", 15000.0, "E207", "E140", "E118"), ("PO-1", None, None, None, None, None)]
    got = R.duty_conflicts(spark.createDataFrame(orders, "po string, vendor string, amount double, requested_by string, approved_by string, paid_by string"), roles, related)
    assert {(r.po, r.rule) for r in got.collect()} == {("PO-2204", "SOD-01"), ("PO-2301", "SOD-02"), ("PO-2317", "SOD-03"), ("PO-2402", "SOD-04")}


def test_gaps_and_coverage_of_keys_outside_the_domain(spark):
    rows = spark.createDataFrame([("a", 2, 4), ("a", 6, 20), ("b", 30, 40), ("c", 0, 50)], "k string, s int, e int")
    stamped = rows.select("k", *[F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("s", "e")])
    low, high = (F.timestamp_seconds(F.lit(x)).cast("timestamp_ntz") for x in (0, 10))
    gaps = {(r.k, r.gap_start.second, r.gap_end.second) for r in T.gaps(stamped, "k", "s", "e", low, high).collect()}
    assert gaps == {("a", 0, 2), ("a", 4, 6), ("b", 0, 10)}
    assert {r.k: r.coverage for r in T.coverage(stamped, "k", "s", "e", low, high).collect()} == {"a": 0.6, "b": 0.0, "c": 1.0}


def test_rules_whose_atoms_share_no_variable(spark):
    facts = spark.createDataFrame([("p", ["a"]), ("p", ["b"]), ("q", ["c"]), ("r", ["b", "c"])], "pred string, args array<string>")
    known = R.derived(facts, ["s(X, Y) :- p(X), q(Y).", "t(X) :- p(X), q(Y), r(X, Y)."])
    assert {tuple(r) for r in R.answers(known, "s(A, B)").collect()} == {("a", "c"), ("b", "c")}
    assert [r[0] for r in R.answers(known, "t(A)").collect()] == ["b"]


def test_hubs_are_cut(spark, monkeypatch):
    edges = spark.createDataFrame([(f"u{k}", f"z{j}") for k in range(40) for j in range(3) if (k + j) % 4], "src string, dst string")
    key = ["u", "v", "common_neighbors", "preferential_attachment"]
    whole = {tuple(r) for r in G.link_scores(edges).select(*key).collect()}
    monkeypatch.setattr(G, "HUB", 7)
    assert {tuple(r) for r in G.link_scores(edges).select(*key).collect()} == whole and len(whole) > 500


def brute_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            left.append(c)
    if not left:
        score = 0.0
    else:
        apart = sum(x != y for x, y in zip(left, (b[j] for j in sorted(taken))))
        score = (len(left) / len(a) + len(left) / len(b) + (len(left) - apart / 2) / len(left)) / 3
    lead = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return score + min(lead, 4) * 0.1 * (1 - score)


def test_jaro_winkler_against_brute_force(spark):
    rnd = random.Random(40)
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("", "x"), ("abcd", "abcd"), ("ab", "ba")]
    pairs += [("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))), "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert abs(r.s - (brute_jaro_winkler(r.a, r.b) if r.a and r.b else 0.0)) < 1e-9, (r.a, r.b)


def cliques(spark):
    rows = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1"), ("c2", "a2")]
    return edges(spark, rows), rows


def test_modular_communities_find_cliques(spark):
    frame, rows = cliques(spark)
    got = G.modular_communities(frame)
    found = {r.node: r.community for r in got.collect()}
    assert len(set(found.values())) == 3 and all(found[n][0] == n[0] for n in found)
    m = len(rows)
    degree = {n: sum(n in r for r in rows) for n in found}
    want = sum(sum(found[a] == c == found[b] for a, b in rows) / m - (sum(degree[n] for n in found if found[n] == c) / (2 * m)) ** 2 for c in set(found.values()))
    assert abs(G.modularity(frame, got).first().modularity - want) < 1e-9


def test_path_rows_against_brute_force(spark):
    rnd = random.Random(50)
    links = {(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}"): rnd.randint(1, 5) for _ in range(40)}
    links = {k: w for k, w in links.items() if k[0] != k[1]}
    frame = spark.createDataFrame([(a, b, "t", float(w)) for (a, b), w in links.items()], "src string, dst string, type string, weight double")
    best = {"n0": (0.0, "n0")}
    for _ in range(20):
        for (a, b), w in sorted(links.items()):
            if a in best and b != "n0":
                best[b] = min(best.get(b, (1e9, "")), (best[a][0] + w, f"{best[a][1]}>{b}"))
    got = {r.node: (r.distance, r.path) for r in G.path_rows(frame, "n0").collect()}
    assert {n: d for n, (d, _) in got.items()} == {n: d for n, (d, _) in best.items()}
    for n, (d, path) in got.items():
        nodes = path.split(">")
        assert nodes[0] == "n0" and nodes[-1] == n and sum(links[a, b] for a, b in zip(nodes, nodes[1:])) == d


def test_betweenness_from_sources_adds_up(spark):
    frame, rows = cliques(spark)
    every = spark.createDataFrame([(n,) for n in sorted({x for r in rows for x in r})], "id string")
    n = every.count()
    whole = {r.node: r.betweenness for r in G.betweenness(frame).collect()}
    part = {r.node: r.betweenness for r in G.betweenness(frame, sources=every).collect()}
    for k, v in whole.items():
        assert abs(v * (n - 1) * (n - 2) - part[k] * n * (n - 1)) < 1e-9


def test_arrow_files_hold_all_rows(spark, tmp_path):
    import pyarrow as pa

    made = writers.arrow_files(spark.range(0, 1000, 1, 3).withColumn("t", F.md5(F.col("id").cast("string"))), f"{tmp_path}/arrow").collect()
    rows = [x for r in made for x in pa.ipc.open_file(r.file).read_all()["id"].to_pylist()]
    assert sorted(rows) == list(range(1000)) and sum(r.rows for r in made) == 1000


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from graphloom.operators.loops import Saved, scratch, shared_folder

    kept = Saved(spark, "kept").save(spark.range(3))
    with scratch(spark):
        inside = Saved(spark, "inside")
        out = Saved(spark, "nested").save(inside.save(spark.range(5)))
        assert out.count() == 5 and os.path.isdir(inside.root)
    assert not os.path.exists(inside.root) and kept.count() == 3 and os.path.isdir(shared_folder(spark))


def test_proofs_and_recursive_chunks_on_edge_cases(spark):
    facts = spark.createDataFrame([("p", ["a", "b"]), ("p", ["b", "c"]), ("other", ["x"])], "pred string, args array<string>")
    told = R.proofs(facts, ["q(X, Z) :- p(X, Y), p(Y, Z).", "z(X) :- other(X)."], "q(a, W)").collect()
    assert [(r.args, r.depth, r.rule) for r in told] == [(["a", "c"], 1, 0)]
    assert R.proofs(facts, [], "p(a, W)").count() == 1 and R.proofs(facts, [], "none(W)").count() == 0
    texts = spark.createDataFrame([("",), (None,), ("short",), ("x" * 950,), ("one. two\n\n" * 90,)], "t string")
    for r in texts.select("t", X.recursive_chunks(F.col("t"), 400, 80).alias("c")).collect():
        if r.t is None:
            assert r.c is None
        else:
            assert all(len(c.chunk) <= 400 for c in r.c) and (not r.t or (r.c[0].start == 0 and r.c[-1].end == len(r.t)))
            assert all(b.start <= a.end for a, b in zip(r.c, r.c[1:]))


def test_ranks_across_tasks(spark, monkeypatch):
    from graphloom.operators import loops

    monkeypatch.setattr(loops, "TASK_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("g"), F.hash("id").alias("x"), "id").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = loops.ranked(rows, "g", F.desc("x"), "id").collect()
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: (-r.x, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_large_blocks_are_dealt_to_several_tasks(spark, monkeypatch):
    from graphloom.operators import dedup

    rows = spark.createDataFrame([(k, f"name {k % 5}") for k in range(60)], "id long, name string")
    monkeypatch.setattr(dedup, "BLOCK", 7)
    got = {tuple(r) for r in dedup.candidates(rows, key="id", name="name", keys=F.array(F.col("name"), F.lit("all"))).select("a", "b").collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_the_package_is_shipped_whole(spark):
    import zipfile

    from graphloom.sources.tables import ship

    ship(spark)
    with zipfile.ZipFile(next(f for f in sorted(spark.sparkContext._python_includes) if f == "graphloom.zip") and __import__("pyspark").SparkFiles.get("graphloom.zip")) as z:
        assert "graphloom/operators/loops.py" in z.namelist()


def test_retries_wait_as_told():
    from graphloom.plans.pipeline import Retry, attempted, severity

    assert [Retry(strategy="linear").delay(k) for k in (1, 2, 3)] == [1, 2, 3]
    assert [Retry(longest=3).delay(k) for k in (1, 2, 3)] == [1, 2, 3] and Retry(strategy="fixed").delay(9) == 1
    waits, calls = [], iter([TimeoutError(), RuntimeError(), None])

    def call():
        if (e := next(calls)) is not None:
            raise e
        return "done"

    assert attempted(call, sleep=waits.append) == "done" and waits == [1, 2]
    with pytest.raises(ValueError):
        attempted(lambda: int("x"), sleep=waits.append)
    assert waits == [1, 2] and severity(MemoryError()) == "critical"
