"""Date helpers for point-in-time data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))


def disclosure_deadline(record: Column) -> Column:
    """Statutory deadline of a report period: Q1 04-30, H1 08-31, Q3 10-31, FY next 04-30."""
    y, m = F.year(record), F.month(record)
    return (
        F.when(m == 3, F.make_date(y, F.lit(4), F.lit(30)))
        .when(m == 6, F.make_date(y, F.lit(8), F.lit(31)))
        .when(m == 9, F.make_date(y, F.lit(10), F.lit(31)))
        .when(m == 12, F.make_date(y + 1, F.lit(4), F.lit(30)))
    )


def parse_date(text: Column) -> Column:
    """ISO, slashed or compact text to a date; anything else is null."""
    t = F.trim(text.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(t, F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(t, F.lit("yyyyMMdd")),
    ).cast("date")
