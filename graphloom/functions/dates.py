"""Dates and periods in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(text: Column, today: Column) -> Column:
    """struct<start date, end date> (end not included) of an ISO date, year-month, year,
    quarter (Q3 2024, 2024-Q3) or a phrase: today, yesterday, last / this year, quarter or
    month, N days, months or years ago. Null for anything else."""
    t = F.lower(F.trim(text))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))

    def number(pattern: str, group: int = 1) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(t, pattern, group), F.lit("")), F.lit("9999")).cast("int")

    def grain(name: str, months: int) -> list[tuple[Column, Column]]:
        start = F.trunc(today, name)
        return [
            (t == f"this {name}", span(start, F.add_months(start, months))),
            (t == f"last {name}", span(F.add_months(start, -months), start)),
        ]

    quarter = F.coalesce(number(r"^q([1-4])\s*[- ]?\s*[0-9]{4}$"), number(r"^[0-9]{4}\s*[- ]?\s*q([1-4])$"))
    of = F.coalesce(number(r"^q[1-4]\s*[- ]?\s*([0-9]{4})$"), number(r"^([0-9]{4})\s*[- ]?\s*q[1-4]$"))
    quarter_start = F.make_date(of, 3 * quarter - 2, F.lit(1))
    iso = F.try_to_date(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(F.nullif(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2})$", 1), F.lit("")), F.lit("-01")), "yyyy-MM-dd")
    year = F.make_date(number(r"^([0-9]{4})$"), F.lit(1), F.lit(1))
    ago = number(r"^([0-9]{1,4}) (?:day|month|year)s? ago$")
    unit = F.regexp_extract(t, r"^[0-9]{1,4} (day|month|year)s? ago$", 1)
    back = F.when(unit == "day", F.date_sub(today, ago)).when(unit == "month", F.add_months(today, -ago)).when(unit == "year", F.add_months(today, -12 * ago))
    out = F.lit(None).cast("struct<start:date,end:date>")
    cases = [
        (iso.isNotNull(), span(iso, F.date_add(iso, 1))), (month.isNotNull(), span(month, F.add_months(month, 1))), (year.isNotNull(), span(year, F.add_months(year, 12))),
        (quarter.isNotNull() & of.isNotNull(), span(quarter_start, F.add_months(quarter_start, 3))),
        (t == "today", span(today, F.date_add(today, 1))), (t == "yesterday", span(F.date_sub(today, 1), today)), (ago.isNotNull(), span(back, today)),
        *grain("month", 1), *grain("quarter", 3), *grain("year", 12),
    ]
    for holds, value in reversed(cases):
        out = F.when(holds, value).otherwise(out)
    return out
