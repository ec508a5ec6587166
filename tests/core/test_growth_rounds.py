"""Walks and rounds over all links: what a task holds and what is sent is bounded."""

from __future__ import annotations

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("longest", [9, 60])
def test_least_digest_of_many(monkeypatch, longest):
    from graphloom.functions import digests as D

    monkeypatch.setattr(D, "PAIRS", 50)
    r = random.Random(3)
    names = ["", *("".join(r.choices("aé7", k=r.randrange(longest))) for _ in range(130))]
    prefixes = ["".join(r.choices("xyü|", k=r.randrange(longest // 2))) for _ in range(60)]
    ends = [sorted(r.sample(range(len(names) + 1), 2)) for _ in prefixes]
    digest, chosen = D.least_md5(pa.array(prefixes), *np.array(ends).T, pa.array(names))
    for p, (a, b), d, j in zip(prefixes, ends, digest, chosen, strict=True):
        assert d == min(hashlib.md5((p + n).encode()).hexdigest() for n in names[a:b])
        assert a <= j < b and d == hashlib.md5((p + names[j]).encode()).hexdigest()


@pytest.mark.parametrize("part", [7, 65_536], ids=["hubs in cells", "whole"])
def test_hashed_walks_meet_neighbours_in_their_blocks(spark, monkeypatch, part):
    from graphloom.operators import walks as W

    monkeypatch.setattr(W, "PART", part)
    monkeypatch.setattr(W, "LEAST", 4)
    plans, save = [], W.Saved.save
    monkeypatch.setattr(W.Saved, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    r = random.Random(8)
    edges = [(f"c{k}", "hub") for k in range(40)] + [(f"c{r.randrange(40)}", f"s{r.randrange(12)}") for _ in range(120)] + [("x.1", "0.0.hub"), ("c1", "c1"), (None, "c2")]
    near = {}
    for a, b in edges:
        if a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in near:
        path = [start]
        for k in range(1, 5):
            path.append(min(near[path[-1]], key=lambda d: hashlib.md5(f"{start}|{k}|{d}".encode()).hexdigest()))
        want[start] = ">".join(path)
    assert {x.start: x.path for x in W.hashed_walks(spark.createDataFrame(edges, "src string, dst string"), 4).collect()} == want
    assert sum("FlatMapCoGroupsInArrow" in p for p in plans) == 4


def test_walks_and_factors_stay_in_their_blocks(spark, monkeypatch):
    from graphloom.operators import embeddings as EM

    r = random.Random(4)
    edges = spark.createDataFrame([(f"a{r.randrange(30)}", f"b{r.randrange(9)}") for _ in range(90)], "src string, dst string")
    alone = EM.node_embeddings(edges, dimensions=4, walks=2, length=3, window=2, q=0.5).orderBy("node").collect()
    plans, save = [], EM.Saved.save
    monkeypatch.setattr(EM, "LEAST", 3)
    monkeypatch.setattr(EM, "TABLE", 1)
    monkeypatch.setattr(EM.Saved, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    got = EM.node_embeddings(edges, dimensions=4, walks=2, length=3, window=2, q=0.5).orderBy("node").collect()
    assert [x.node for x in got] == [x.node for x in alone]
    assert np.allclose(np.abs([x.embedding for x in got]), np.abs([x.embedding for x in alone]))
    assert sum("FlatMapCoGroupsInArrow" in p for p in plans) >= 2 + 8  # steps; rounds


def _settled(of, most):
    end = time.time() + 20
    while (n := of()) > most and time.time() < end:  # files are deleted in the background
        time.sleep(0.1)
    return n


def test_a_saved_table_leaves_no_shuffle_files(spark):
    from graphloom.operators import loops as LO

    files = lambda: len(list(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")))
    before, option = files(), spark.conf.get(LO._CLEANUP, None)
    held = LO.Saved(spark, "sums").save(spark.range(1000).groupBy((F.col("id") % 70).alias("k")).count())
    assert _settled(files, before) <= before
    assert spark.conf.get(LO._CLEANUP, None) == option
    assert held.count() == 70


def test_walks_and_factors_keep_the_tables_of_a_step(spark, monkeypatch):
    from graphloom.operators import embeddings as EM

    made, init = [], EM.Saved.__init__
    monkeypatch.setattr(EM.Saved, "__init__", lambda self, *a: init(self, *a) or made.append(self))
    r = random.Random(4)
    edges = spark.createDataFrame([(f"a{r.randrange(30)}", f"b{r.randrange(9)}") for _ in range(90)], "src string, dst string")
    EM.node_embeddings(edges, dimensions=4, walks=2, length=6, window=2, q=0.5).collect()
    left = {s.root.rsplit("/", 1)[1].split("-")[0]: (len(list(Path(s.root).glob("[0-9]*"))) if Path(s.root).exists() else 0, s.count) for s in made}
    assert left["walks"][0] == 0 and left["steps"][0] < left["steps"][1] / 2
    assert left["rounds"][0] <= 3 < left["rounds"][1]


def test_draws_behind_a_sure_one_are_not_sent_along():
    from graphloom.operators import embeddings as EM

    rows = pa.table({"walk": [1, 2, 3]})
    got = EM._chosen(rows, pa.array(list("abcdefghi")), np.array([[-1, 0, 1], [0, 1, 0], [-1, 1, 0]])).to_pylist()
    assert [(r["to"], r["drawn"]) for r in got] == [(None, [None, "b", "c"]), (None, ["d", "e", None]), ("h", None)]


def test_blocks_of_links_are_of_a_size_that_fits_tasks():
    import tracemalloc

    from graphloom.operators import blocks as B

    r = np.random.default_rng(5)
    n = B.LINKS
    s, t = np.sort(r.integers(0, n // 30, n)), r.integers(0, n, n)
    start = np.searchsorted(s, np.arange(s[-1] + 2))
    links = pa.table({"block": pa.array(np.zeros(n, np.int32)), "s": s, "t": t})
    tracemalloc.start()
    B._packed(1)(links)
    B.most_frequent(t[: start[-1]], np.unique(start))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500e6  # of four tasks at a time, less than 2 GB


def test_ways_back_keep_the_tables_of_a_step(spark, monkeypatch):
    from graphloom.operators import chains as C

    made, init, plans, save = [], C.Saved.__init__, [], C.Saved.save
    monkeypatch.setattr(C.Saved, "__init__", lambda self, *a: init(self, *a) or made.append(self))
    monkeypatch.setattr(C.Saved, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    edges = spark.createDataFrame([(1, "a", "b", 0, 1), (2, "b", "a", 1, 2), (3, "a", "c", 5, 6), (4, "c", "a", 7, 9), (5, "x", "x", 3, 3)], "id long, src string, dst string, start long, end long")
    got = {(r.id, ">".join(r.nodes)) for r in C.time_cycles(edges).collect()}
    assert got == {(1, "a>b>a"), (3, "a>c>a"), (5, "x>x")}
    assert [s.root for s in made if "/cycles-" in s.root and Path(s.root).exists()] == []
    # no window looks at all that is behind each row
    assert not any("unboundedfollowing" in p.lower() for p in plans)


def test_an_orders_rows_are_shuffled_once(spark):
    from graphloom.plans import deeper as D

    rows = D.handovers(spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_moves_of_communities_keep_a_rounds_table_and_shuffle_half_of_the_links(spark, monkeypatch):
    from graphloom.operators import communities as CO

    made, init, plans, save = [], CO.Saved.__init__, [], CO.Saved.save
    monkeypatch.setattr(CO.Saved, "__init__", lambda self, *a: init(self, *a) or made.append(self))
    monkeypatch.setattr(CO.Saved, "save", lambda self, df: plans.append((self.root, df._jdf.queryExecution().optimizedPlan().toString())) or save(self, df))
    ends = [(f"{g}{a}", f"{g}{b}", 1.0 + a) for g in "xyz" for a in range(5) for b in range(a)] + [("x0", "y0", 1.0), ("y1", "z1", 1.0)]
    edges = spark.createDataFrame(ends, "src string, dst string, weight double")
    out = CO.levelled(edges, weight="weight")
    got = {}
    for r in out.last().collect():
        got.setdefault(r.community, set()).add(r.node)
    assert got == {f"{g}0": {f"{g}{k}" for k in range(5)} for g in "xyz"}
    labels = out.last().withColumnRenamed("community", "label")
    assert out.modularity[-1] == pytest.approx(CO.modularity(CO.weighted_links(edges, "weight"), labels))
    assert sorted({s.root for s in made if Path(s.root).exists()}) == sorted({s.root for s in made if "/communities-" in s.root})
    # links meet the labels of their far ends, and nothing to tell whose turn it is
    assert all(p.count("Join") <= 4 for root, p in plans if "/moves-" in root)


@pytest.mark.parametrize("way", ["betweenness", "closeness"])
def test_pairs_of_nodes_have_numbers(spark, monkeypatch, way):
    from graphloom.operators import graph as G

    kinds, save = set(), G.Saved.save
    monkeypatch.setattr(G.Saved, "save", lambda self, df: kinds.update(dict(df.dtypes)[c] for c in df.columns if c == "s") or save(self, df))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), (None, "a"), ("x", "y")], "src string, dst string")
    some = spark.createDataFrame([("a",), ("x",), ("a",), ("lone",)], "id string")
    if way == "betweenness":
        got = {r.node: r.betweenness for r in G.betweenness(edges, sources=some.distinct()).collect()}
        assert got == pytest.approx({"a": 0.0, "b": 2 / 10, "c": 1 / 10, "d": 0.0, "x": 0.0, "y": 0.0})
    else:
        got = {r.id: r.closeness for r in G.closeness(edges, some.distinct()).collect()}
        assert got == pytest.approx({"a": 3 / 6 * 3 / 5, "x": 1 / 5, "lone": 0.0})
    assert kinds == {"bigint"}
