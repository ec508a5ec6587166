"""Merkle witnesses against trees that are built level by level from their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, witnesses


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its proof: (siblings before, behind) a level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, k in enumerate(at):
            low = k // 3 * 3
            proofs[x].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 3])))
        nodes, at = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0] if nodes else None, proofs


def manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> what the query returns."""
    least = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((least(r[0]), leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: (sorted(groups[s], key=lambda x: x[:2]), *tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])])) for s in names}
    root, tops = tree([parts[s][1] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        held, subroot, proofs = parts[s]
        for (_, own, r), proof in zip(held, proofs, strict=True):
            at = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                at = leaf(*r[:4], r[4].replace("\n", ""))
            for before, after in proof + top:
                at = h(before + at + after)
            out.append((r[0], own, subroot, root, h("".join(b + a for b, a in proof + top)), at, at == root))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def rows(n, sources, seed=1):
    rnd = random.Random(seed)
    some = lambda v: None if rnd.random() < 0.05 else v
    ids = rnd.sample(range(-50, 10 * n), n)
    return [(some(i), rnd.choice(sources), some("en"), some(rnd.randint(0, 9)), some(rnd.choice(["a\nb", "é\n", "", "plain", "x" * 300 + "\n"]))) for i in ids]


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (1, ["a"]), (7, [None]), (40, ["a", "b", None, "", "ä", "z"]), (2300, ["hot"] * 9 + ["b", "c", None]), (900, [str(k) for k in range(900)])])
def test_query_equals_brute_force(spark, tmp_path, n, sources):
    data = rows(n, sources)
    data += data[:3]  # repeated rows
    spark.createDataFrame(data, FIELDS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_witnesses(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(manifest(data), key=str)
    if n > 7:
        assert {r[-1] for r in got} == {True, False}


def test_open_subtrees_hold_partial_witnesses():
    """A witness is extended by later siblings alone: what is there stays."""
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        nodes, trees, seen = [h(str(k)) for k in range(n)], witnesses.Subtrees(), []
        for node in nodes:
            trees.append(node)
            for old, new in zip(seen, trees.witnesses, strict=False):
                assert new[: len(old)] == old
            seen = [list(w) for w in trees.witnesses]
        root = trees.close()
        assert (root, trees.witnesses) == tree(nodes)


def test_appended_equals_built_at_once(spark):
    data = rows(2000, ["hot", "hot", "hot", "b", None], seed=4)
    data = sorted((r for r in data if r[0] is not None), key=lambda r: r[0])
    data.append((10**9, "new", "en", 1, "late"))
    made = lambda part: spark.createDataFrame(part, FIELDS).select("doc_id", "source", witnesses.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"))
    grown = witnesses.Manifest(made(data[:30]), group="source", order="doc_id")
    for a, b in ((30, 900), (900, 901), (901, len(data))):
        grown = grown.appended(made(data[a:b]), group="source", order="doc_id")
    whole = witnesses.Manifest(made(data), group="source", order="doc_id")
    assert grown.root == whole.root
    assert sorted(map(str, grown.witnesses().collect())) == sorted(map(str, whole.witnesses().collect()))


def test_awkward_names(spark):
    data = spark.createDataFrame([(1, "a", "x", "r"), (2, None, "y", "s")], "`id.x` long, `so``u` string, leaf string, root string")
    out = witnesses.Manifest(data, group="so`u", order="id.x").witnesses()
    assert out.columns == ["id.x", "so`u", "leaf", "subroot", "root", "proof"]
    assert {r.root for r in out.collect()} == {h("yx")}
