"""Clusters, overlaps, chains, routes and levels against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chains as C
from graphloom.operators import clusters as CL
from graphloom.operators import communities as CO
from graphloom.operators import graph as G
from graphloom.operators import intervals as I
from graphloom.operators import routes as R


def agglomerated(nodes, sims, threshold):
    """Average linkage, the most similar two clusters at a time."""
    groups = [{n} for n in nodes]
    mean = lambda x, y: sum(sims.get((min(p), max(p)), 0.0) for p in itertools.product(x, y)) / (len(x) * len(y))
    while True:
        best = max(((mean(x, y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)), default=(0,))
        if best[0] < threshold:
            return {n: min(g) for g in groups if len(g) > 1 for n in g}
        _, i, j = best
        groups[i] |= groups.pop(j)


@pytest.mark.parametrize("seed, n, share", [(1, 12, 0.9), (2, 24, 0.5), (3, 40, 0.25)])
def test_average_linkage_equals_agglomeration(spark, seed, n, share):
    rnd = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(n)]
    sims = {p: round(rnd.random() ** 0.7, 6) + 0.001 for p in itertools.combinations(nodes, 2) if rnd.random() < share}
    pairs = spark.createDataFrame([(b, a, s) if rnd.random() < 0.5 else (a, b, s) for (a, b), s in sims.items()], "a string, b string, score double")
    got = {r.node: r.cluster for r in CL.average_linkage(pairs, 0.4).collect()}
    assert got == agglomerated(nodes, sims, 0.4) and got
    clusters = spark.createDataFrame(list(got.items()), "node string, cluster string")
    for r in CL.quality(pairs, clusters, most=3).collect():
        inside = [sims.get(p, 0.0) for p in itertools.combinations(sorted(k for k, v in got.items() if v == r.cluster), 2)]
        assert r.quality == pytest.approx(sum(inside) / len(inside) * (1.0 if r.size <= 3 else 0.8))


def test_new_nodes_go_to_their_nearest_cluster(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "node string, cluster string")
    pairs = spark.createDataFrame([("new", "a", 0.9), ("new", "x", 0.6), ("new", "y", 0.6), ("far", "a", 0.7)], "a string, b string, score double")
    assert {tuple(r) for r in CL.assigned(pairs, clusters, 0.5).collect()} == {("new", "x", 0.6)}
    with pytest.raises(ValueError, match="above 0"):
        CL.average_linkage(pairs, 0.0)


def overlapping(left, right, touching):
    at = lambda v, d: d if v is None else v
    out = Counter()
    for x, y in itertools.product(left, right):
        a, b, c, d = at(x[2], I.ALWAYS), at(x[3], I.NEVER), at(y[2], I.ALWAYS), at(y[3], I.NEVER)
        if x[1] == y[1] and a <= b and c <= d and (a <= d and c <= b if touching else a < d and c < b):
            out[x[0], y[0]] += 1
    return out


@pytest.mark.parametrize("touching", [True, False])
def test_overlaps_equal_all_pairs(spark, touching):
    rnd = random.Random(7)

    def rows(n):
        out = []
        for k in range(n):
            a = rnd.choice((rnd.randint(-5000, 5000), rnd.randint(0, 100)))
            b = a + rnd.choice((0, 1, 7, 8, 9, rnd.randint(-5, 60), rnd.randint(0, 9000)))
            out.append((k, rnd.choice("xy"), None if rnd.random() < 0.05 else a, None if rnd.random() < 0.05 else b))
        return out

    left, right = rows(250), rows(200)
    made = lambda x: spark.createDataFrame(x, "id long, k string, start long, end long")
    got = I.overlap_join(made(left), made(right), on=["k"], touching=touching, width=4).select("l.id", F.col("r.id").alias("other"))
    assert Counter(map(tuple, got.collect())) == overlapping(left, right, touching)
    assert I.overlap_join(made(left).limit(0), made(right), on=["k"]).count() == 0


def test_a_bin_with_most_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 50)
    left = spark.range(900).select(F.col("id"), F.lit("k").alias("k"), F.lit(10).alias("start"), F.lit(11).alias("end"))
    right = spark.range(7).select(F.col("id"), F.lit("k").alias("k"), F.lit(11).alias("start"), (F.col("id") * 1000 + 11).alias("end"))
    got = I.overlap_join(left, right, on=["k"], width=4)
    assert got.count() == 6300 == got.select("l.id", F.col("r.id").alias("o")).distinct().count()


def followed(edges, tolerance, itself=False):
    """The reference rule: candidates by start, then id."""
    out = {}
    for e in edges:
        if e[4] is None:
            continue
        next_ = [f for f in edges if f[1] == e[2] and f[3] is not None and (itself or f[0] != e[0]) and f[3] >= e[4] and (tolerance is None or f[3] - e[4] <= tolerance)]
        if next_:
            out[e[0]] = min(next_, key=lambda f: (f[3], f[0]))
    return out


def timed(seed, n, nodes, flat=0.0):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        a = rnd.randint(0, 300)
        out.append((k, rnd.choice(nodes), rnd.choice(nodes), None if rnd.random() < 0.03 else a, None if rnd.random() < 0.03 else a + (0 if rnd.random() < flat else rnd.randint(1, 40))))
    return out


EDGE = "id long, src string, dst string, start long, end long"


@pytest.mark.parametrize("seed, tolerance, flat", [(1, 0, 0.0), (2, 5, 0.0), (3, 30, 0.1), (4, 0, 0.6)])
def test_chains_equal_the_greedy_rule(spark, seed, tolerance, flat):
    edges = timed(seed, 260, "abcde", flat)
    step = followed(edges, tolerance)
    # of a loop of edges without duration, the step back to its smallest edge goes
    for k in list(step):
        seen, at = [], k
        while at in step and at not in seen:
            seen.append(at)
            at = step[at][0]
        if at in seen:
            loop = seen[seen.index(at) :]
            del step[next(x for x in loop if step[x][0] == min(loop))]
    want = {}
    for e in edges:
        nodes, at = [e[1], e[2]], e[0]
        while at in step:
            nodes.append(step[at][2])
            at = step[at][0]
        if len(nodes) > 2:
            want[e[0]] = (nodes, at)
    got = {r.id: (r.nodes, r.last) for r in C.chains(spark.createDataFrame(edges, EDGE), tolerance=tolerance, width=16).collect()}
    assert got == want and got


def test_a_loop_of_edges_without_duration(spark):
    edges = [(1, "a", "b", 5, 5), (2, "b", "c", 5, 5), (3, "c", "a", 5, 5), (4, "z", "a", 1, 5), (5, "q", "q", 9, 9)]
    got = {r.id: ">".join(r.nodes) for r in C.chains(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {1: "a>b>c>a", 2: "b>c>a", 4: "z>a>b>c>a"}


def test_time_cycles_equal_the_greedy_rule(spark):
    edges = timed(5, 220, "abcd")
    step = followed(edges, None, itself=True)
    want = {}
    for e in edges:
        nodes, at, n = [e[1], e[2]], e[0], 1
        while n <= 6:
            if nodes[-1] == nodes[0]:
                want[e[0]] = nodes
                break
            if at not in step or (step[at][2] in nodes[1:-1] and step[at][2] != nodes[0]):
                break
            nodes, at, n = [*nodes, step[at][2]], step[at][0], n + 1
    got = C.time_cycles(spark.createDataFrame(edges, EDGE), width=16)
    assert {r.id: r.nodes for r in got.collect()} == want and want
    counted = Counter(">".join(n) for n in want.values())
    assert {tuple(r) for r in C.patterns(got, min_frequency=2).collect()} == {x for x in counted.items() if x[1] >= 2}


def simple_paths(edges, start, goal):
    out = []

    def grow(path, weights):
        if path[-1] == goal:
            out.append((path, weights))
            return
        for a, b, w in edges:
            if a == path[-1] and b not in path:
                grow([*path, b], [*weights, w])

    grow([start], [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_best_paths_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    nodes = "abcdefg"
    edges = [(a, b, float(rnd.randint(1, 4))) for a in nodes for b in nodes if a != b and rnd.random() < 0.45]
    frame = spark.createDataFrame([*edges, ("a", "a", 1.0)], "src string, dst string, weight double")
    every = simple_paths(edges, "a", "g")
    cheap = sorted((sum(w), len(p) - 1, p) for p, w in every)[:4]
    assert [(r.cost, r.hops, r.path) for r in R.best_paths(frame, "a", "g", k=4).orderBy("rank").collect()] == cheap
    wide = sorted((-min(w), len(p) - 1, p) for p, w in every)[:3]
    assert [(-r.width, r.hops, r.path) for r in R.best_paths(frame, "a", "g", k=3, widest=True).orderBy("rank").collect()] == wide
    assert R.best_paths(frame, "a", "nowhere", k=2).count() == 0
    rows = {r.node: (r.width, r.parent) for r in R.widest_rows(frame, "a").collect()}
    for node, (width, parent) in rows.items():
        if node != "a":
            assert width == max(min(w) for _, w in simple_paths(edges, "a", node))
            assert width == min(rows[parent][0], max(w for a, b, w in edges if (a, b) == (parent, node)))


def test_all_paths_are_found_in_order(spark):
    frame = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 2.0), ("c", "d", 2.0), ("b", "c", 0.0)], "src string, dst string, weight double")
    assert [">".join(r.path) for r in R.best_paths(frame, "a", "d", k=10).orderBy("rank").collect()] == ["a>b>d", "a>b>c>d", "a>c>d"]


def test_cliques_in_a_ring_are_communities(spark):
    n, k = 12, 5
    edges = [(f"{c:02d}.{a}", f"{c:02d}.{b}") for c in range(n) for a in range(k) for b in range(a)]
    edges += [(f"{c:02d}.0", f"{(c + 1) % n:02d}.1") for c in range(n)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    fine = CO.levelled(frame, resolution=2.0)
    assert {(r.node, r.community) for r in fine.last().collect()} == {(f"{c:02d}.{a}", f"{c:02d}.0") for c in range(n) for a in range(k)}
    found = CO.levelled(frame)
    assert found.modularity == sorted(found.modularity)
    flat = G.modularity(frame, G.modular_communities(frame)).first().modularity
    assert found.modularity[-1] >= flat - 1e-9
    assert G.modularity(frame, found.last()).first().modularity == pytest.approx(found.modularity[-1])
    # a smaller resolution puts cliques together, never apart
    coarse = {r.node: r.community for r in CO.levelled(frame, resolution=0.2).last().collect()}
    assert len(set(coarse.values())) < n and all(coarse[f"{c:02d}.{a}"] == coarse[f"{c:02d}.0"] for c in range(n) for a in range(k))


def test_weights_make_communities(spark):
    edges = [("a", "b", 9.0), ("c", "d", 9.0), ("b", "c", 0.1), ("a", "d", 0.1), ("a", "c", 0.1), ("b", "d", 0.1)]
    got = CO.levelled(spark.createDataFrame(edges, "src string, dst string, w double"), weight="w").last()
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
