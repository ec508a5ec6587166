"""Further steps whose intermediate rows must not outgrow their input."""

from __future__ import annotations

import random

import pytest


@pytest.mark.parametrize("tail", [0, 40], ids=["few parents", "many parents"])
def test_lineage_is_followed_from_shared_parents(spark, monkeypatch, tail):
    from graphloom.operators import versions as VS

    r = random.Random(2)
    edges = [(f"o{k}", f"p{r.randrange(6)}") for k in range(30) for _ in range(3)] + [(f"p{k}", f"q{r.randrange(8)}") for k in range(6) for _ in range(2)] + [("q0", "z"), ("q1", "o0"), ("o1", "o0"), ("z", "z")]
    edges += [(f"o{k}", f"t{k}-{j}") for k in range(30) for j in range(tail)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    names = sorted(({x for e in edges for x in e} | {"lone"}) - {"q2"})
    sources = [(x, f"{x[0]}{n}", r.randrange(100), r.randrange(100)) for x in names for n in range(1 + (x == "z"))]
    starts = sorted({f"o{k}" for k in range(30)} | {"lone"})
    want = {}
    for s in starts:
        met, todo = {s}, [s]
        while todo:
            todo = [y for x in todo for y in up.get(x, ()) if y not in met and not met.add(y)]
        own = [x for x in sources if x[0] in met]
        want[s] = (len({x[0] for x in own}) - 1, len({x[1] for x in own}), min(x[2] for x in own), max(x[3] for x in own))
    seen, reach = [], VS.reachable
    monkeypatch.setattr(VS, "reachable", lambda e, s: seen.append(s.count()) or reach(e, s))
    monkeypatch.setattr(VS, "LIST", 2, raising=False)
    got = VS.lineage(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(sources, "node string, source string, first_seen long, last_seen long"))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want
    assert seen == [len(starts) if tail else len({b for a, b in edges if a in starts})]


@pytest.mark.parametrize("widest", [False, True])
def test_best_paths_are_searched_from_the_goal_with_numbers_alone(spark, monkeypatch, widest):
    from graphloom.operators import routes as R

    rows, signed = [], R.Saved.signed

    def counted(self, df, *columns):
        out = signed(self, df, *columns)
        rows.append(out[1][0])
        assert "path" not in df.columns and "label" not in df.columns
        return out

    monkeypatch.setattr(R.Saved, "signed", counted)
    # what the start leads to besides the goal is many nodes, which no way to the goal meets
    edges = [("a", "g", 1.0), ("a", "b", 0.5), ("b", "g", 1.5), ("a", "x", 0.2)] + [("x", f"y{k}", 0.1) for k in range(200)]
    got = R.best_paths(spark.createDataFrame(edges, "src string, dst string, weight double"), "a", "g", k=2, widest=widest).orderBy("rank").collect()
    assert [(r[1], r.path) for r in got] == ([(1.0, ["a", "g"]), (0.5, ["a", "b", "g"])] if widest else [(1.0, ["a", "g"]), (2.0, ["a", "b", "g"])])
    assert sum(rows) < 10


def test_rounds_send_values_to_blocks_not_along_links(spark, monkeypatch):
    from collections import Counter

    from graphloom.operators import blocks as B
    from graphloom.operators import graph as G

    monkeypatch.setattr(B, "LINKS", 60)
    monkeypatch.setattr(B, "LEAST", 3)
    plans, save = [], B.Saved.save
    monkeypatch.setattr(B.Saved, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    r = random.Random(6)
    edges = [(f"p{r.randrange(60)}", f"s{r.randrange(9)}") for _ in range(150)] + [("p1", "p1"), ("s1", "p1"), (None, "s1"), ("u", "v")]
    near = {}
    for a, b in edges:
        if a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    frame = spark.createDataFrame(edges, "src string, dst string")
    rank, score, label = {x: 1 / len(near) for x in near}, dict.fromkeys(near, 1.0), {x: x for x in near}
    for k in range(7):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
        score = {x: score[x] + sum(score[y] for y in near[x]) for x in near}
        if k < 4:
            votes = {x: Counter(label[y] for y in near[x]) for x in near}
            label = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    size = sum(v * v for v in score.values()) ** 0.5
    rounded = lambda rows: {x[0]: round(x[1], 12) for x in rows.collect()}
    assert rounded(G.pagerank(frame, rounds=7)) == {x: round(v, 12) for x, v in rank.items()}
    assert rounded(G.eigenvector(frame, rounds=7)) == {x: round(v / size, 12) for x, v in score.items()}
    assert {x[0]: x[1] for x in G.label_propagation(frame, rounds=4).collect()} == label
    assert any("FlatMapCoGroupsInArrow" in p for p in plans)


@pytest.mark.parametrize("way", ["chains", "time_cycles"])
def test_edges_in_time_are_computed_once(spark, monkeypatch, way):
    from graphloom.operators import chains as C

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, save = [], C.Saved.save
    monkeypatch.setattr(C.Saved, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    edges = spark.createDataFrame([(1, "a", "b", 0, 1), (2, "b", "a", 1, 2), (3, "a", "c", 5, 6)], "id long, src string, dst string, start long, end long")
    out = C.chains(edges, tolerance=9) if way == "chains" else C.time_cycles(edges)
    got = {(r.id, ">".join(r.nodes)) for r in out.collect()}
    assert got == ({(1, "a>b>a>c"), (2, "b>a>c")} if way == "chains" else {(1, "a>b>a")})
    assert sum("ExistingRDD" in p or "LocalTableScan" in p for p in [*plans, plan(out)]) == 1
