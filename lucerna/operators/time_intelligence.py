"""Time intelligence over a column of dates: facts are summed by day or month first, then windows or shifted joins."""

from __future__ import annotations

from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"year": ["y"], "quarter": ["y", "q"], "month": ["y", "m"]}
MONTHS = {"month": 1, "quarter": 3, "semester": 6, "year": 12}
#: How many units a grouping covers that names no period.
DEFAULT_UNITS = {"month": 12, "quarter": 4, "semester": 2, "year": 5, "week": 8, "day": 30}
Span = tuple[Date, Date]


def by_day(df: DataFrame, date: str, value: str, name: str, kind: str = "decimal(38,4)") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("day")).agg(F.sum(F.col(value).cast("decimal(18,4)")).cast(kind).alias(name))


def by_month(df: DataFrame, date: str, value: str, name: str, kind: str = "decimal(38,4)") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(F.sum(F.col(value).cast("decimal(18,4)")).cast(kind).alias(name))


def to_date(df: DataFrame, date: str, value: str, name: str, unit: str = "year") -> DataFrame:
    """TOTALYTD, TOTALQTD, TOTALMTD: the running total since the period began; groups are whole periods."""
    keys = {"y": F.year(date), "q": F.quarter(date), "m": F.month(date)}
    w = Window.partitionBy(*(keys[k] for k in UNITS[unit])).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def moved(d: Column, n: int, unit: str) -> Column:
    return F.date_add(d, n) if unit == "day" else F.add_months(d, n * MONTHS[unit])


def shifted(df: DataFrame, date: str, value: str, name: str, n: int, unit: str = "month") -> DataFrame:
    """DATEADD, SAMEPERIODLASTYEAR on a column of days or months: the value n units away. A day that the other month
    lacks falls on its last day, where values add up."""
    there = df.groupBy(moved(F.col(date), -n, unit).alias("__at")).agg(F.sum(value).alias(name))
    return df.join(there, F.col(date) == F.col("__at"), "left").drop("__at")


def whole_period(df: DataFrame, date: str, value: str, name: str, n: int, unit: str) -> DataFrame:
    """PARALLELPERIOD, PREVIOUSDAY to PREVIOUSYEAR (-1), NEXTDAY to NEXTYEAR (1): the total of the whole unit that lies
    n units from the row's own."""
    start = F.col(date) if unit == "day" else F.trunc(date, unit)
    sums = df.groupBy(start.alias("__of")).agg(F.sum(value).alias(name))
    return df.join(sums, moved(start, n, unit) == F.col("__of"), "left").drop("__of")


def edges(df: DataFrame, date: str, unit: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """FIRSTDATE, LASTDATE of the visible dates, and the first and last existing date of their units (STARTOF..., ENDOF...)."""
    seen = df.groupBy(*groups).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    of_unit = df.groupBy(F.trunc(date, unit).alias("__u")).agg(F.min(date).alias("start_of"), F.max(date).alias("end_of"))
    a, b = of_unit.select(F.col("__u").alias("__a"), "start_of"), of_unit.select(F.col("__u").alias("__b"), "end_of")
    return seen.join(a, F.trunc("first_date", unit) == F.col("__a"), "left").join(b, F.trunc("last_date", unit) == F.col("__b"), "left").drop("__a", "__b")


def in_period(df: DataFrame, date: str, value: str, name: str, n: int, unit: str = "month") -> DataFrame:
    """DATESINPERIOD: total of the n units that end here, or begin here if n is below 0; existing dates only. Each date
    goes to the few that hold it."""
    steps = F.sequence(F.lit(0), F.lit(abs(n) - 1)) if n else F.array().cast("array<int>")
    spread = df.select(F.explode(steps).alias("k"), date, value)
    k = F.col("k") * (1 if n > 0 else -1)
    at = F.date_add(F.col(date), k) if unit == "day" else F.add_months(F.col(date), k * MONTHS[unit])
    sums = spread.groupBy(at.alias("__at")).agg(F.sum(value).alias(name))
    return df.join(sums, F.col(date) == F.col("__at"), "left").drop("__at")


def between(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """DATESBETWEEN: both ends belong to it; no bound is an open one."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(date) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def buckets(df: DataFrame, date: str, value: str, name: str, start: str, end: str, unit: str) -> DataFrame:
    """A row for each calendar unit of a period, clipped to it, empty ones too (BLANK)."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    own = lambda d: F.to_date(F.date_trunc(unit, d))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(own(F.lit(start).cast("date")), own(F.lit(end).cast("date")), F.expr(step))).alias("bucket"))
    sums = between(df, date, start, end).groupBy(own(F.col(date)).alias("__b")).agg(F.sum(value).alias(name))
    return spine.join(sums, F.col("bucket") == F.col("__b"), "left").drop("__b")


def year_months(start: str, end: str) -> list[tuple[int, int]]:
    """The months that a range touches, as pairs for treat_as."""
    a, b = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (start, end))
    return [(m // 12, m % 12 + 1) for m in range(a, b + 1)]


def start_of(d: Column, unit: str) -> Column:
    """The first day of a date's unit; a semester begins in January or July."""
    if unit == "semester":
        return F.make_date(F.year(d), F.when(F.month(d) > 6, 7).otherwise(1), F.lit(1))
    return F.to_date(F.date_trunc(unit, d))


def _first(today: Date, unit: str, n: int = 0) -> Date:
    """The first day of the unit that lies n units from today's."""
    size = MONTHS[unit]
    months = (today.year * 12 + today.month - 1) // size * size + n * size
    return Date(months // 12, months % 12 + 1, 1)


def last_units(today: str, n: int, unit: str) -> Span:
    """The last n whole months, quarters, semesters or years; n days or weeks up to today. The end does not belong to it."""
    day = Date.fromisoformat(today)
    if unit in MONTHS:
        return _first(day, unit, -n), _first(day, unit)
    return day + timedelta(1 - n * (7 if unit == "week" else 1)), day + timedelta(1)


def default_units(today: str, unit: str) -> Span:
    """What a grouping by this unit covers if no period is asked: whole units, but years with the current one, weeks from
    a Monday up to today and days up to today."""
    day, n = Date.fromisoformat(today), DEFAULT_UNITS[unit]
    if unit == "year":
        return _first(day, unit, 1 - n), _first(day, unit, 1)
    if unit == "week":
        return day - timedelta(day.weekday() + 7 * (n - 1)), day + timedelta(1)
    return last_units(today, n, unit)


def since(start: str, today: str) -> Span:
    return Date.fromisoformat(start), Date.fromisoformat(today) + timedelta(1)


def in_span(date: str, span: Span) -> Column:
    """A plain range of literals, which reaches the scan."""
    low, high = (F.lit(str(d)).cast("timestamp_ntz") for d in span)
    return (F.col(date) >= low) & (F.col(date) < high)


def compared(df: DataFrame, date: str, value: str, groups: list[str], spans: dict[str, Span]) -> DataFrame:
    """The same total in several periods side by side, in one aggregation; groups without rows in all of them are out."""
    some = F.lit(False)
    for span in spans.values():
        some = some | in_span(date, span)
    return df.where(some).groupBy(*groups).agg(*(F.sum(F.when(in_span(date, s), F.col(value))).alias(k) for k, s in spans.items()))


def covers(first: Column, end: Column, span: Span, today: str, slack: int = 1) -> Column:
    """Whether the window from first to end (out of it; null: open) holds a period, which ends today at the latest. Days
    of slack count at the end, and at the start of periods of two days at most."""
    start, stop = span[0], min(span[1], Date.fromisoformat(today) + timedelta(1))
    late = start + timedelta(slack if stop - start <= timedelta(2) else 0)
    begins = first.isNull() | (first <= F.lit(str(late)).cast("date"))
    return begins & (end.isNull() | (end >= F.lit(str(stop - timedelta(slack))).cast("date")))
