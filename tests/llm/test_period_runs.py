"""Periodic runs against a comparison of every word with every other."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import period_runs, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, times=4, least=6):
    """(start, length, smallest period) of all runs, from their definition."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def planted(rnd, n):
    """Words of a small vocabulary with nested repeats of many periods."""
    words = []
    while len(words) < n:
        q = rnd.choice((1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 60, 64, 65))
        unit = [rnd.choice("abcdefgh") for _ in range(q)]
        if rnd.random() < 0.3:
            unit = unit[: max(1, q // 3)] * 5 + unit
        words += (unit * 12)[: rnd.randint(q, 7 * len(unit))]
        words += [rnd.choice("abc") for _ in range(rnd.randint(0, 12))]
    return words[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    texts = [planted(rnd, rnd.choice((0, 1, 5, 6, 40, 300, 900))) for _ in range(12)]
    texts += [["a"] * k for k in (5, 6, 7, 200)] + [list("ab") * 40, list("abcdefghi") * 4, list("abcdefghi") * 4 + ["a"]]
    texts.append([rnd.choice("ab") for _ in range(400)])
    codes = period_runs.Codes()
    flat = np.array([codes[w] for t in texts for w in t], dtype=np.int64)
    got = period_runs.Runs(flat, np.concatenate(([0], np.cumsum([len(t) for t in texts])))).of_texts()
    for k, words in enumerate(texts):
        assert got.get(k, []) == brute(words), (k, words)


def test_the_selected_positions_are_few():
    """Long highly periodic texts, for which every position would be selected, take no longer."""
    text = np.array(list(range(20)) * 20_000)
    got = period_runs.Runs(text, np.array([0, len(text)])).of_texts()
    assert got == {0: [(0, 400_000, 20)]}


def digests(doc_id, text):
    words = looped(doc_id, WORDS.findall(text or ""))
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    spaces = [" ", "\n", "\t", "  ", "\r\n", "\x0b", " ", " "]
    texts = ["".join(w + rnd.choice(spaces) for w in planted(rnd, rnd.choice((1, 8, 50, 250)))) for _ in range(120)]
    texts += ["", " \n ", None, "a a a a a a", " a a a a a ", "😀 " * 9, "x y " * 3000]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, "a b " * 12), (None, None)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_period_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digests(i, t) for i, t in rows), key=str)


def test_operator_keeps_texts_and_columns(spark):
    rows = spark.createDataFrame([(1, "go go go go go go now", "a", 9), (2, None, None, 9), (3, "one two", "b", 9)], "doc_id long, text string, `so``u.rce` string, runs int")
    out = period_runs.periodic_runs(rows)
    assert out.columns == ["doc_id", "so`u.rce", "n_words", "runs", "collapsed"]
    assert {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect()} == {(1, 7, ((0, 6, 1),), "go now"), (2, 0, (), ""), (3, 2, (), "one two")}
    assert period_runs.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="four times"):
        period_runs.periodic_runs(rows, times=3)
