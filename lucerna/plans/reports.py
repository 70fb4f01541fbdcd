"""Reports over a model: filters as reports write them, ranked and detailed lists, shares, merged tables, data windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tables as T
from ..operators.model import Context, Key, Model


def categorical(column: str, values: Iterable, text: bool = True, negate: bool = False) -> Column:
    """Column in these values: text without case, None is BLANK. Negated, BLANK stays unless it is among the values or
    equals one of them (0 or an empty text)."""
    values = list(values)
    known = [v.lower() if isinstance(v, str) else v for v in values if v is not None]
    x = F.lower(column) if text else F.col(column)
    hit = F.coalesce(x.isin(*known), F.lit(False)) if known else F.lit(False)
    blank = None in values or (negate and any(v in ("", 0) for v in known))
    hit = hit | F.col(column).isNull() if blank else hit
    return ~hit if negate else hit


def dated(column: str, start: str | None = None, end: str | None = None, year: int | None = None, months: Iterable[int] = ()) -> Column:
    """Dates from start to end (out of it), of a year, of months of that year or of any year. Ranges, and years with their
    single months, are plain comparisons that reach the scan."""
    months = sorted(set(months))
    if year is not None and len(months) <= 1:
        m = months[0] if months else 1
        start = f"{year}-{m:02d}-01"
        end = f"{year + 1}-01-01" if not months or m == 12 else f"{year}-{m + 1:02d}-01"
        months = []
    elif year is not None:
        start, end = f"{year}-01-01", f"{year + 1}-01-01"
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return out & F.month(column).isin(*months) if months else out


def ranked(model: Model, groups: list[str], measure: str, n: int | None = None, largest: bool = True, context: Context = Context()) -> DataFrame:
    """Groups by a measure. With a limit, groups with a BLANK key go, and the first n stay with all that tie with the last."""
    df = model.query(groups, [measure], context)
    if n is None:
        return df
    for g in groups:
        df = df.where(F.col(Key.of(g).alias).isNotNull())
    return T.top_n(df, n, (F.col(measure), not largest))


def detail(model: Model, fact: str, columns: list[str], limit: int, context: Context = Context()) -> DataFrame:
    """(columns, n, is_cut): distinct tuples of columns of a fact and its dimensions that the context shows, the first `limit`
    of them in order, and whether there are more."""
    rows = model.calculate_table(fact, context)
    each = model.related(fact, columns, rows=rows).groupBy(*(Key.of(c).alias for c in columns)).agg(F.count("*").alias("n"))
    first = each.orderBy(*(F.col(Key.of(c).alias).asc_nulls_first() for c in columns)).limit(limit + 1)
    size = first.agg((F.count("*") > limit).alias("is_cut"))  # one row
    return first.limit(limit).crossJoin(F.broadcast(size))


def data_until(model: Model, date: str, measure: str, context: Context, period: Iterable[str] = ()) -> DataFrame:
    """(until): the last date at which a measure is not BLANK, under the context without its filters on the period."""
    df = model.query([date], [measure], context.remove(*period, Key.of(date).column))
    return df.where(F.col(measure).isNotNull()).agg(F.max(Key.of(date).alias).alias("until"))


def shares(model: Model, groups: list[str], measure: str, context: Context, over: Iterable[str]) -> DataFrame:
    """(groups, value, share): a measure under the context, and its part of the measure without the filters `over`."""
    own = model.query(groups, [measure], context).withColumnRenamed(measure, "value")
    whole = model.query(groups, [measure], context.remove(*over)).withColumnRenamed(measure, "__whole")
    keys = [Key.of(g).alias for g in groups]
    both = own.crossJoin(F.broadcast(whole)) if not keys else own.join(whole.toDF(*(f"__{k}" for k in keys), "__whole"), _same(keys), "left")
    return both.select(*keys, "value", F.try_divide(F.col("value").cast("double"), F.nullif(F.col("__whole").cast("double"), F.lit(0.0))).alias("share"))


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return on


def common_filters(contexts: list[Context]) -> tuple[Context, list[Context]]:
    """What filters several contexts share, and what each has of its own. A filter is one by its columns and its text."""
    named = [[((c, str(p)), (c, p)) for c, p in x.filters] for x in contexts]
    shared = set.intersection(*({n for n, _ in own} for own in named)) if named else set()
    common = Context(tuple(f for n, f in named[0] if n in shared)) if named else Context()
    return common, [Context(tuple(f for n, f in own if n not in shared)) for own in named]


def composed(frames: list[DataFrame], keys: list[str], order: str = "place") -> DataFrame:
    """Tables with the same keys merged (null equals null), each row at the place where its key was first seen: in the first
    table that has it, in the order that the table's own `order` column gives."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("__at", F.struct(F.lit(i).alias("table"), F.col(order).cast("double").alias("row"))).drop(order)
        if out is None:
            out = part
            continue
        right = part.toDF(*(f"__{c}" if c in keys else "__then" if c == "__at" else c for c in part.columns))
        rest = [c for c in out.columns if c not in (*keys, "__at")]
        out = out.join(right, _same(keys), "full").select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), *rest, *(c for c in part.columns if c not in (*keys, "__at")), F.coalesce("__at", "__then").alias("__at"))
    return out.select(*(c for c in out.columns if c != "__at"), F.col("__at.table").alias("first_table"), F.col("__at.row").alias("first_row"))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text with a decimal comma: values up to 1 either way are fractions, others per cent already."""
    value = F.when(F.abs(x) <= 1, x * 100).otherwise(x)
    return F.concat(F.translate(F.format_number(value, digits), ",.", ".,"), F.lit(" %"))
