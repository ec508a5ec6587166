"""Causes, impact and arguments against plain Python."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.operators import causes as CA
from graphloom.operators import rules as R

LINKS = "cause string, effect string, type string, weight double"


def some_links(seed):
    rnd = random.Random(seed)
    kinds = ["CAUSED", "INFLUENCED", "PRECEDENT_FOR", "MENTIONS"]
    rows = [(f"d{rnd.randrange(9)}", f"d{rnd.randrange(9)}", rnd.choice(kinds), rnd.choice([0.5, 0.7, 0.9, None])) for _ in range(22)]
    return [*rows, rows[0], (None, "d1", "CAUSED", 0.5), ("d1", None, "CAUSED", 0.5), ("d2", "d2", "CAUSED", 1.0)]


def weights(links, types):
    out = {}
    for cause, effect, kind, w in links:
        if kind in types and cause is not None and effect is not None and cause != effect:
            out[cause, effect] = max(out.get((cause, effect), 0.0), 1.0 if w is None else w)
    return out


def walks(steps, start, hops):
    """(end, hops, product, least) of all ways up from a start."""
    level = [(start, 1.0, 1.0)]
    for n in range(1, hops + 1):
        level = [(c, p * w, min(m, w)) for x, p, m in level for (c, e), w in steps.items() if e == x]
        yield from ((c, n, p, m) for c, p, m in level)


@pytest.mark.parametrize("seed", range(3))
def test_causes_equal_brute_force(spark, seed):
    links = some_links(seed)
    frame = spark.createDataFrame(links, LINKS)
    starts = spark.createDataFrame([("d0",), ("d3",), ("d3",), ("none",)], "start string")
    want = {}
    for s in ("d0", "d3"):
        for c, n, p, m in walks(weights(links, CA.CAUSAL + CA.PRECEDENT), s, 4):
            if c != s:
                want[s, c] = max(want.get((s, c), (0, 0, 0)), (p, -n, m))
    got = {(r.start, r.cause): (r.strength, -r.hops, r.weakest) for r in CA.reports(frame, starts, max_hops=4).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k] == pytest.approx(want[k]) for k in want)

    steps = weights(links, CA.CAUSAL)
    roots = {}
    for s in ("d0", "d3"):
        for c, n, _, _ in walks(steps, s, 6):
            if all(e != c for _, e in steps):
                roots[s, c] = min(roots.get((s, c), n), n)
    assert {(r.start, r.cause): r.hops for r in CA.roots(frame, starts, max_hops=6).collect()} == roots

    sure = {f"d{k}": k / 10 for k in range(9)} | {"d8": None, "alone": 0.4}
    back = {(e, c): w for (c, e), w in steps.items()}
    before = weights(links, CA.PRECEDENT)
    for r in CA.impact(frame, spark.createDataFrame(list(sure.items()), "decision string, confidence double"), max_hops=5).collect():
        follows = {c for c, *_ in walks(back, r.decision, 5)} - {r.decision}
        known = {c for c, *_ in walks(before, r.decision, 5)} - {r.decision}
        total = sum(sure[x] or 0 for x in follows) + 0.5 * sum(sure[x] or 0 for x in known)
        assert (r.influenced, r.precedents) == (len(follows), len(known))
        assert r.score == pytest.approx(min(1.0, total / (max(len(follows), 1) + 0.5 * max(len(known), 1))))


def test_no_links(spark):
    none = spark.createDataFrame([], LINKS)
    starts = spark.createDataFrame([("a",)], "start string")
    assert CA.reports(none, starts).isEmpty() and CA.roots(none, starts).isEmpty()
    got = CA.impact(none, spark.createDataFrame([("a", None)], "decision string, confidence double")).collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, 0.0)]


RULES = ["b(X, Y) :- a(X, Y).", "c(X, Z) :- b(X, Y), a(Y, Z).", "d(X) :- c(X, X), e(X).", "b(X, X) :- d(X).", "g(X) :- h(X)."]


def one_pass(facts):
    """Facts and, in order, the new ones of one pass over RULES."""
    facts, new = set(facts), []
    for rule in map(R.parsed, RULES):
        heads = set()
        for rows in product(sorted(facts), repeat=len(rule.body)):
            bound = {}
            if all(p == a.pred and len(args) == len(a.args) and all(bound.setdefault(v, x) == x for v, x in zip(a.args, args, strict=True)) for a, (p, args) in zip(rule.body, rows, strict=True)):
                heads.add((rule.head.pred, tuple(bound[v] for v in rule.head.args)))
        new += sorted(heads - facts)
        facts |= heads
    return new


def test_arguments_equal_brute_force(spark):
    rnd = random.Random(5)
    names = "xyz"

    def fact(kinds):
        kind = rnd.choice(kinds)
        return kind, tuple(rnd.choice(names) for _ in range(1 if kind in "degh" else 2))

    known = [fact("aaeh") for _ in range(3)]
    said = {f"n{k}": [fact("aabeh") for _ in range(rnd.randrange(5))] for k in range(14)}
    claims = {n: [fact("bcdg")] for n in said} | {"n1": [fact("bc"), fact("bc")], "only": [fact("bc")]}
    del claims["n2"]
    schema = "argument string, pred string, args array<string>"

    def rows(table):
        return spark.createDataFrame([(n, p, list(args)) for n, fs in table.items() for p, args in fs], schema)

    got = {r.argument: r for r in R.arguments(rows(said), rows(claims), RULES, known=spark.createDataFrame([(p, list(a)) for p, a in known], "pred string, args array<string>")).collect()}
    assert set(got) == {n for n in said if said[n]} | set(claims)
    general = one_pass(known)
    for n, r in got.items():
        facts = said.get(n, [])
        new = one_pass({*known, *facts})
        assert r.valid == (n in claims and all(c in new for c in claims[n])), n
        assert r.unknown_premises == len(set(facts) - set(known))
        # what follows from what is known alone is nobody's own conclusion
        assert r.conclusions == len(set(new) - set(general)), n
    assert any(r.valid for r in got.values()) and any(not r.valid for r in got.values())
