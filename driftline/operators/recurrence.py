"""Occurrences of recurring events within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How often a series may recur.
EVERY = {"daily": 1, "weekly": 7, "monthly": 1, "yearly": 12}  # days, days, months, months


def occurrences(series: DataFrame, low: str, high: str, exceptions: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The days on which each series occurs between low and high, both included:
    its columns and ``occurrence``, a date.

    A series has first (date), freq (daily, weekly, monthly or yearly), every (a
    whole number above 0, null: 1) and maybe until (date) and times (how often at
    all). Months without the day and years without 29 February are left out, but
    count as none of ``times``. ``exceptions`` are (key, occurrence) rows that
    don't take place. Only numbers of steps that can fall in the range are made,
    so a series is as many rows as it has days there.
    """
    lo, hi = F.lit(low).cast("date"), F.lit(high).cast("date")
    every = F.greatest(F.coalesce(F.col("every"), F.lit(1)), F.lit(1))
    last = F.least(hi, F.coalesce(F.col("until"), hi))
    months = F.months_between(F.trunc(lo, "month"), F.trunc("first", "month"))
    until_months = F.months_between(F.trunc(last, "month"), F.trunc("first", "month"))
    days, until_days = F.datediff(lo, F.col("first")), F.datediff(last, F.col("first"))
    by_day = F.col("freq").isin("daily", "weekly")
    unit = F.create_map(*[F.lit(x) for kv in EVERY.items() for x in kv])[F.col("freq")] * every
    begin = F.greatest(F.lit(0), F.floor(F.when(by_day, days).otherwise(months) / unit)).cast("long")
    end = F.floor(F.when(by_day, until_days).otherwise(until_months) / unit).cast("long")
    # Where steps may miss (day 29 and later), ``times`` counts those that exist,
    # so all from the first are made; else the range alone decides.
    gaps = ~by_day & (F.dayofmonth("first") > 28) & F.col("times").isNotNull()
    begin = F.when(gaps, F.lit(0).cast("long")).otherwise(begin)
    end = F.when(F.col("times").isNotNull() & ~gaps, F.least(end, F.col("times") - 1)).otherwise(end)
    steps = F.when((end >= begin) & F.col("freq").isin(*EVERY), F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>"))

    def day(n: Column) -> Column:
        months_on = F.add_months("first", (n * unit).cast("int"))
        return F.when(by_day, F.date_add("first", (n * unit).cast("int"))).when(F.dayofmonth(months_on) == F.dayofmonth("first"), months_on)

    made = F.array_compact(F.transform(steps, day))
    made = F.when(gaps, F.slice(made, F.lit(1), F.greatest(F.lit(0), F.col("times")).cast("int"))).otherwise(made)
    out = series.select("*", F.explode(made).alias("occurrence")).where(F.col("occurrence").between(lo, last))
    return out if exceptions is None else out.join(exceptions.select(key, "occurrence"), [key, "occurrence"], "left_anti").select(*series.columns, "occurrence")
