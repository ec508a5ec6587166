"""Node embeddings, threshold joins and semantic chunks against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import embeddings as EM
from graphloom.operators import semantic as SE
from graphloom.operators import vector_join as VJ


def cliques(k=6):
    edges = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a in range(k) for b in range(a)]
    return [*edges, ("x0", "y0")]


def test_walks_follow_the_biases(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "e")]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    got = EM.biased_walks(spark.createDataFrame(edges, "src string, dst string"), walks=1500, length=3, p=0.25, q=2.0).collect()
    assert Counter(r.path[0] for r in got) == dict.fromkeys(near, 1500) and all(len(r.path) == 3 for r in got)
    steps = Counter(tuple(r.path) for r in got)
    for a, b in itertools.permutations(near, 2):
        if b in near[a]:
            weight = {c: 4.0 if c == a else 1.0 if c in near[a] else 0.5 for c in near[b]}
            n = sum(steps[a, b, c] for c in near[b])
            for c, w in weight.items():
                share = w / sum(weight.values())
                assert abs(steps[a, b, c] - n * share) < 5 * math.sqrt(n * share * (1 - share)) + 1
    again = EM.biased_walks(spark.createDataFrame(edges, "src string, dst string"), walks=2, length=4)
    assert sorted(again.collect()) == sorted(again.collect()) and {tuple(sorted(p)) for r in again.collect() for p in zip(r.path, r.path[1:])} <= {tuple(sorted(e)) for e in edges}


def test_information_and_factors(spark):
    paths = [["a", "b", "c", "a"], ["c", "d"], ["b", "d", "d", "a", "c"]]
    counts = Counter()
    for p in paths:
        for i, j in itertools.combinations(range(len(p)), 2):
            if j - i <= 2:
                counts[p[i], p[j]] += 1
                counts[p[j], p[i]] += 1
    total, one = sum(counts.values()), Counter()
    for (u, _), n in counts.items():
        one[u] += n
    want = {x: m for x, n in counts.items() if (m := math.log(n * total / (one[x[0]] * one[x[1]]))) > 0}
    table = EM.information(spark.createDataFrame([(p,) for p in paths], "path array<string>"), window=2)
    got = {(r.u, r.v): r.m for r in table.collect()}
    assert got == pytest.approx(want)
    names = sorted({u for u, _ in want})
    matrix = np.array([[want.get((u, v), 0.0) for v in names] for u in names])
    rows = {r.node: np.array(r.embedding) for r in EM.factorised(table, dimensions=len(names), rounds=12).collect()}
    value, turn = np.linalg.eigh(matrix)
    size = turn @ np.diag(np.abs(value)) @ turn.T
    ours = np.array([rows[n] for n in names])
    assert np.allclose(ours @ ours.T, size, atol=1e-6)


def test_neighbours_are_nearer_than_strangers(spark):
    rows = {r.node: np.array(r.embedding) for r in EM.node_embeddings(spark.createDataFrame(cliques(), "src string, dst string"), dimensions=4, walks=6, length=8, window=2).collect()}
    cosine = lambda a, b: rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b])
    inside = [cosine(f"{c}{a}", f"{c}{b}") for c in "xy" for a, b in itertools.combinations(range(6), 2)]
    across = [cosine(f"x{a}", f"y{b}") for a in range(6) for b in range(6)]
    assert np.mean(inside) > np.mean(across) + 0.3


@pytest.mark.parametrize("bound", [0.3, 0.8, 0.99])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(VJ, "BLOCK", 20)
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vectors = {k: [c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)] for k in range(160)}
    vectors[160] = [2 * x for x in vectors[0]]
    rows = [*vectors.items(), (200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] + [1.0] * 5), (204, [float("inf")] * 6)]
    got = {(r.a, r.b): r.cosine for r in VJ.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), bound, key="id", vector="v", pivots=7).collect()}
    cosine = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    want = {(a, b): c for a, b in itertools.combinations(vectors, 2) if (c := cosine(vectors[a], vectors[b])) >= bound}
    assert got == pytest.approx(want)
    none = spark.createDataFrame([], "id long, v array<double>")
    assert VJ.similar_pairs(none, bound, key="id", vector="v").count() == 0


def test_semantic_chunks_cut_between_subjects(spark):
    text = "Red cats eat fish. Red cats eat mice. Red cats eat cream. Old ships sail west. Old ships sail north. Old ships sail home."
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "One only."), (5, "Same. Same. Same.")], "id long, text string")
    got = {(r.id, r.chunk): (r.first, r.sentences, r.text) for r in SE.semantic_chunks(rows, key="id", text="text", quantile=0.4).collect()}
    half = text.index("Old")
    assert got == {(1, 0): (0, 3, text[: half - 1]), (1, 1): (3, 3, text[half:]), (4, 0): (0, 1, "One only."), (5, 0): (0, 3, "Same. Same. Same.")}
