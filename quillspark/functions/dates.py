"""Dates and months. Dates of the data model are ISO strings; ordering is by string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import strip


def parse_de(x: Column) -> Column:
    """DD.MM.YYYY as an ISO date, one-digit days and months too; anything else stays as trimmed text."""
    t = strip(F.coalesce(x, F.lit("")))
    return F.coalesce(F.try_to_timestamp(t, F.lit("d.M.yyyy")).cast("date").cast("string"), t)


def month_of(x: Column) -> Column:
    """YYYY-MM of a text that starts with it, else NULL."""
    return F.when(x.rlike(r"^\d{4}-\d{2}"), F.substring(x, 1, 7))


def year_of(x: Column) -> Column:
    """The first four characters as a number; NULL if they are none."""
    return F.substring(x, 1, 4).try_cast("int")


def yesterday() -> Column:
    return F.date_sub(F.current_date(), 1)


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm 'UTC'")


def month_ranges(df: DataFrame, start: Column, stop: Column) -> DataFrame:
    """One row per calendar month from that of `start` to that of `stop`: month_start and the first day after it."""
    months = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(stop, "MM"), F.expr("interval 1 month")))
    return df.select(months.alias("month_start")).withColumn("month_end", F.add_months("month_start", 1))
