"""Text and code normalisation as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def money(text: Column) -> Column:
    """Money text to a number: 亿 x1e8, 万 x1e4, % /100; dashes and blanks are 0."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[,，]", ""))
    num = F.coalesce(F.regexp_replace(t, "[亿万%]", "").try_cast("double"), F.lit(0.0))
    unit = F.when(t.contains("亿"), 1e8).when(t.contains("万"), 1e4).when(t.contains("%"), 0.01).otherwise(1.0)
    return F.when(t.isin("", "-", "--"), 0.0).otherwise(num * unit)


def percent(text: Column) -> Column:
    """"12.3%" to 12.3; null when it is not a number."""
    return F.regexp_replace(F.trim(text.cast("string")), "%", "").try_cast("double")


def code(raw: Column) -> Column:
    """First six digits in a row, else the digits left-padded to six."""
    t = F.trim(raw.cast("string"))
    six = F.regexp_extract(t, r"(\d{6})", 1)
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(six != "", six).when(digits != "", F.lpad(digits, 6, "0")).otherwise("")


def market_prefix(six: Column) -> Column:
    first = F.substring(six, 1, 1)
    return F.concat(F.when(first == "6", "sh").when(first.isin("0", "3"), "sz").when(first.isin("4", "8", "9"), "bj").otherwise(""), six)


def resolve(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Pick, for each standard name, the first alias present (exact, then any case)."""
    lower = {c.lower(): c for c in df.columns}
    out = []
    for name, cands in aliases.items():
        hit = next((c for c in cands if c in df.columns), None) or next((lower[c.lower()] for c in cands if c.lower() in lower), None)
        if hit is not None:
            out.append(F.col(hit).alias(name))
    return df.select(*out)


def first_token(text: Column) -> Column:
    return F.trim(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[\s|]+")[0])


def to_ten_thousands(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric flow columns in yuan become 10k units when the column maximum shows yuan."""
    top = df.agg(F.struct(*[F.max(F.abs(c)).alias(c) for c in cols])).scalar()
    return df.withColumns({c: F.when(top.getField(c) > 1e6, F.col(c) / 1e4).otherwise(F.col(c)) for c in cols})
