"""Periods in text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from graphloom.functions.dates import period

TODAY = date(2024, 5, 17)
WANT = {
    "2024-02-28": (date(2024, 2, 28), date(2024, 2, 29)),
    "2024-02": (date(2024, 2, 1), date(2024, 3, 1)),
    "1999": (date(1999, 1, 1), date(2000, 1, 1)),
    "Q3 2024": (date(2024, 7, 1), date(2024, 10, 1)),
    "2023-q4": (date(2023, 10, 1), date(2024, 1, 1)),
    " Today ": (date(2024, 5, 17), date(2024, 5, 18)),
    "yesterday": (date(2024, 5, 16), date(2024, 5, 17)),
    "last month": (date(2024, 4, 1), date(2024, 5, 1)),
    "this quarter": (date(2024, 4, 1), date(2024, 7, 1)),
    "last year": (date(2023, 1, 1), date(2024, 1, 1)),
    "10 days ago": (date(2024, 5, 7), date(2024, 5, 17)),
    "2 years ago": (date(2022, 5, 17), date(2024, 5, 17)),
    "soon": None,
    "2024-13-40": None,
    "": None,
}


def test_periods(spark):
    rows = spark.createDataFrame([(k,) for k in WANT] + [(None,)], "t string").select("t", period(F.col("t"), F.lit(TODAY)).alias("p"))
    got = {r.t: r.p and tuple(r.p) for r in rows.collect()}
    assert got == {**WANT, None: None}
