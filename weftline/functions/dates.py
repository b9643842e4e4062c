"""Dates and freshness as column expressions. What "now" is, is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(value: Column) -> Column:
    """A date from text: YYYY-MM-DD; a timestamp with an offset, by its UTC day; else the first ten characters; else null."""
    v = F.trim(value)
    day = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))
    zoned = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$"), F.to_date(v.try_cast("timestamp")))
    return F.coalesce(day(v), zoned, day(F.substring(v, 1, 10)))


def freshness(day: Column, as_of: Column, half_life: float = 30, floor: float = 0, ceil: float = 1) -> Column:
    """ceil * 0.5 ** (age / half_life), within [floor, ceil]; 0 for a future or missing date."""
    age = F.datediff(as_of, day)
    score = F.greatest(F.lit(float(floor)), F.least(F.lit(float(ceil)), F.lit(float(ceil)) * F.pow(F.lit(0.5), age / F.lit(float(half_life)))))
    return F.when(day.isNull() | (age < 0), F.lit(0.0)).otherwise(score)


def bucket(score: Column) -> Column:
    """hot from .85, fresh from .60, warm from .40, else stale; missing for null."""
    return F.when(score.isNull(), "missing").when(score >= 0.85, "hot").when(score >= 0.60, "fresh").when(score >= 0.40, "warm").otherwise("stale")


def day_bucket(day: Column, as_of: Column) -> Column:
    """The bucket of a date's freshness; missing for a null date."""
    return F.when(day.isNull(), "missing").otherwise(bucket(freshness(day, as_of)))


def default_range(start: Column, end: Column, now: Column, days: int = 7) -> tuple[Column, Column]:
    """start and end of a period: the end is now if it is not given, the start ``days`` days before the end."""
    end = F.coalesce(end, now)
    return F.coalesce(start, end - F.make_dt_interval(F.lit(days))), end


def period(token: Column, now: Column) -> Column:
    """today, yesterday or NdaysAgo as that day's date; an ISO date as it is; else null."""
    n = F.regexp_extract(token, r"^(\d+)daysAgo$", 1)
    today = F.to_date(now)
    return F.when(token == "today", today).when(token == "yesterday", F.date_sub(today, 1)).when(n != "", F.date_sub(today, F.nullif(n, F.lit("")).try_cast("int"))).otherwise(parsed(token))
