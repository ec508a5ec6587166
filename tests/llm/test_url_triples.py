"""Rules of three tokens that are all weak by themselves, in urls with many stronger ones."""

from __future__ import annotations

import random

from graphloom.llm import url_rules


def test_triples_beyond_the_strongest_tokens_are_found(spark):
    r = random.Random(4)
    rows = []
    for _ in range(3000):
        bad = r.random() < 0.3
        own = [f"s{k}" for k in range(10) if r.random() < (0.6 if bad else 0.4)]
        # of three coins: bad rows have three heads or one, others two or none
        flips = r.choice([("a", "b", "c"), ("a",), ("b",), ("c",)] if bad else [("a", "b"), ("a", "c"), ("b", "c"), ()])
        rows.append((own + [f"w{x}" for x in flips], bad))
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    want = ["wa", "wb", "wc"]
    found = {tuple(x.antecedent): (x.rows, x.bad) for x in url_rules.mined(frame, min_count=5, width=4).collect()}
    of = [bad for tokens, bad in rows if set(want) <= set(tokens)]
    assert found[tuple(want)] == (len(of), sum(of))
