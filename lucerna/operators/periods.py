"""Periods as sets of dates: what a time function makes of the dates that a calendar shows in each group.

The sets are rows (group, day), never ranges to compare with: each range is spelled out in its days and met with the
calendar's by equality. A group's set is as long as its period, and there are as many groups as the calendar has, so their
number grows with the calendar alone, not with facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = {"month": 1, "quarter": 3, "year": 12}


@dataclass(frozen=True)
class Period:
    """A date function on a calendar's column of dates. kind:

    to_date   DATESYTD, DATESQTD, DATESMTD, TOTALYTD, ...: from the start of the last date's unit up to it
    shift     DATEADD, SAMEPERIODLASTYEAR: each date moved by n units, whole months as whole months
    before    PREVIOUSDAY, ..MONTH, ..QUARTER, ..YEAR: the whole unit n (-1) units from the first date's
    after     NEXTDAY, ..., NEXTYEAR: the whole unit n (1) units from the last date's
    parallel  PARALLELPERIOD: whole units, from the first date's to the last date's, n units away
    window    DATESINPERIOD: n units that start (n above 0) or end (below 0) at `start`, or at the last date
    between   DATESBETWEEN: from start to end, none is open
    first, last, start, end   FIRSTDATE, LASTDATE, STARTOF..., ENDOF...: one existing date of the calendar
    """

    column: str
    kind: str
    unit: str = "day"
    n: int = 0
    start: str | None = None
    end: str | None = None


def to_date(column: str, unit: str = "year") -> Period:
    return Period(column, "to_date", unit)


def date_add(column: str, n: int, unit: str) -> Period:
    return Period(column, "shift", unit, n)


def same_period_last_year(column: str) -> Period:
    return Period(column, "shift", "year", -1)


def previous(column: str, unit: str) -> Period:
    return Period(column, "before", unit, -1)


def following(column: str, unit: str) -> Period:
    return Period(column, "after", unit, 1)


def parallel(column: str, n: int, unit: str) -> Period:
    return Period(column, "parallel", unit, n)


def window(column: str, n: int, unit: str, start: str | None = None) -> Period:
    return Period(column, "window", unit, n, start)


def between(column: str, start: str | None, end: str | None) -> Period:
    return Period(column, "between", start=start, end=end)


def edge(column: str, kind: str, unit: str = "month") -> Period:
    return Period(column, kind, unit)


def moved(d: Column, n: int, unit: str) -> Column:
    return F.date_add(d, n) if unit == "day" else F.add_months(d, n * MONTHS[unit])


def start_of(d: Column, unit: str) -> Column:
    return d if unit == "day" else F.trunc(d, unit)


def end_of(d: Column, unit: str) -> Column:
    return d if unit == "day" else F.date_add(F.add_months(F.trunc(d, unit), MONTHS[unit]), -1)


def bounds(period: Period) -> tuple[Column, Column]:
    """The first and last day of a group's period, from its first and last date; null is open."""
    first, last, n, unit = F.col("__first"), F.col("__last"), period.n, period.unit
    given = lambda text: F.lit(text).cast("date")
    if period.kind == "to_date":
        return start_of(last, unit), last
    if period.kind == "before":
        return start_of(moved(first, n, unit), unit), end_of(moved(first, n, unit), unit)
    if period.kind == "after":
        return start_of(moved(last, n, unit), unit), end_of(moved(last, n, unit), unit)
    if period.kind == "parallel":
        return start_of(moved(first, n, unit), unit), end_of(moved(last, n, unit), unit)
    if period.kind == "window":
        at = given(period.start) if period.start else last
        return (F.date_add(moved(at, n, unit), 1), at) if n < 0 else (at, F.date_add(moved(at, n, unit), -1))
    if period.kind == "between":
        return given(period.start), given(period.end)
    if period.kind in ("first", "last"):
        return (first, first) if period.kind == "first" else (last, last)
    if period.kind in ("start", "end"):
        at = first if period.kind == "start" else last
        return start_of(at, unit), end_of(at, unit)
    raise ValueError(f"no period of kind {period.kind}")


def dates_of(seen: DataFrame, days: DataFrame, keys: list[str], day: str, period: Period) -> DataFrame:
    """seen (keys, day): the dates shown in each group; days (day): the calendar's. -> (keys, day), distinct: the set of
    each group, existing dates only. A group without dates has none."""
    if period.kind == "shift":
        return shifted(seen, keys, day, period).join(days, day, "left_semi")
    low, high = bounds(period)
    span = days.agg(F.min(day).alias("__low"), F.max(day).alias("__high"))  # one row
    groups = seen.groupBy(*keys).agg(F.min(day).alias("__first"), F.max(day).alias("__last")).where("__first is not null")
    groups = groups.crossJoin(F.broadcast(span)).select(*keys, F.greatest(low, "__low").alias("__a"), F.least(high, "__high").alias("__b"))
    sets = groups.where("__a <= __b").select(*keys, F.explode(F.sequence("__a", "__b")).alias(day)).join(days, day, "left_semi")
    if period.kind in ("start", "end"):
        return sets.groupBy(*keys).agg((F.min if period.kind == "start" else F.max)(day).alias(day))
    return sets


def shifted(seen: DataFrame, keys: list[str], day: str, period: Period) -> DataFrame:
    """Each date n units away; a month that is shown whole becomes a whole month, else a day that the other month lacks
    its last day."""
    n, unit = period.n, period.unit
    if unit == "day":
        return seen.select(*keys, F.date_add(day, n).alias(day)).distinct()
    months = seen.groupBy(*keys, F.trunc(day, "month").alias("__month")).agg(F.collect_set(day).alias("__days"))
    there = moved(F.col("__month"), n, unit)
    full = F.size("__days") == F.dayofmonth(F.last_day("__month"))
    moved_days = F.transform("__days", lambda d: moved(d, n, unit))
    return months.select(*keys, F.explode(F.when(full, F.sequence(there, F.last_day(there))).otherwise(F.array_distinct(moved_days))).alias(day))
