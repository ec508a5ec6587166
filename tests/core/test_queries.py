"""Queries give their SQL's rows on a small copy of the standard tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from graphloom import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = core.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = plain([r.asDict() for r in frame.collect()], columns)
    cursor = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == plain([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], columns)


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_benchmark_items_of_any_length(spark, tmp_path):
    from graphloom.plans import further

    texts = ["one two three four five six seven eight nine", "xone two threes", "a one\ntwo three four five six sevenths b", "two", "", None]
    items = ["one", "two", "one two", "one two three", "two three four five", "one two three four five six", "one two three four five six seven", "one two three four five six seven eight", " two ", "", None, "wo thr"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t is not None and x is not None and x in t}
    got = [tuple(r) for r in further.Q["benchmark_matches"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
