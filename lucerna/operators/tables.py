"""Table operators: ties, bags and value sets as the semantic layer has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .model import Model


def top_n(df: DataFrame, n: int, *order: Column | tuple[Column, bool]) -> DataFrame:
    """The first n rows by the order and all that tie with the last. Keys go down, or up if given with True; BLANK is
    lowest; without keys any n rows. A limit finds the n-th key on its way, a filter the rows."""
    if n <= 0 or not order:
        return df.limit(max(0, n))
    keys = [(o if isinstance(o, tuple) else (o, False)) for o in order]
    k = df.withColumns({f"__k{i}": c for i, (c, _) in enumerate(keys)})
    sort = [F.col(f"__k{i}").asc_nulls_first() if up else F.col(f"__k{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)]
    first = k.select(*(f"__k{i}" for i in range(len(keys)))).orderBy(*sort).limit(n)
    back = [F.col(f"__k{i}").desc_nulls_last() if up else F.col(f"__k{i}").asc_nulls_first() for i, (_, up) in enumerate(keys)]
    edge = first.orderBy(*back).limit(1).select(*(F.col(f"__k{i}").alias(f"__e{i}") for i in range(len(keys))))
    keep = F.lit(True)  # at the edge or before it
    for i in reversed(range(len(keys))):
        a, b, up = F.col(f"__k{i}"), F.col(f"__e{i}"), keys[i][1]
        low, high = (a, b) if up else (b, a)
        before = F.coalesce(low < high, low.isNull() & high.isNotNull())
        keep = before | (a.eqNullSafe(b) & keep)
    return k.crossJoin(F.broadcast(edge)).where(keep).select(*df.columns)  # one row


def ranked(df: DataFrame, by: Column, name: str = "rank", dense: bool = False, within: tuple[str, ...] = (), up: bool = False) -> DataFrame:
    """RANKX: ties share a rank; BLANK values have none. Without `within` the distinct values are sorted by ranges, each
    range counts on from those before it, and ranks are joined back by value: no task sees all values."""
    if within:
        w = Window.partitionBy(*within).orderBy(by.asc_nulls_last() if up else by.desc_nulls_last())
        return df.withColumn(name, F.when(by.isNotNull(), (F.dense_rank() if dense else F.rank()).over(w)))
    order = F.col("__v").asc() if up else F.col("__v").desc()
    each = df.groupBy(by.alias("__v")).agg((F.lit(1) if dense else F.count("*")).cast("long").alias("__n")).where("__v is not null")
    each = written(each.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__id", 33)))
    before, sums = 0, []
    for r in each.groupBy("__range").agg(F.sum("__n").alias("n")).orderBy("__range").collect():  # a row for each partition
        sums.append((r["__range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(sums, "__range long, __before long")
    w = Window.partitionBy("__range").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    place = (F.col("__before") + F.coalesce(F.sum("__n").over(w), F.lit(0)) + 1).cast("int")
    ranks = each.join(F.broadcast(starts), "__range").select("__v", place.alias(name))
    return df.withColumn("__by", by).join(ranks, F.col("__by") == F.col("__v"), "left").drop("__by", "__v")


def share(df: DataFrame, value: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Each row's part of the visible total (ALLSELECTED)."""
    if not within:
        whole = df.agg(F.sum(value).alias("__total"))
        return df.crossJoin(F.broadcast(whole)).withColumn(name, F.try_divide(F.col(value), F.nullif(F.col("__total"), F.lit(0)))).drop("__total")  # one row
    return df.withColumn(name, F.try_divide(F.col(value), F.nullif(F.sum(value).over(Window.partitionBy(*within)), F.lit(0))))


def _matching(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.toDF(*(f"__{i}" for i in range(len(b.columns))))
    on = F.lit(True)
    for i, (name, kind) in enumerate(a.dtypes):
        left, right = F.col(name), F.col(f"__{i}")
        on = on & (F.lower(left).eqNullSafe(F.lower(right)) if kind == "string" else left.eqNullSafe(right))
    return a.join(b, on, how)


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks; a's duplicates stay."""
    return _matching(a, b, "left_anti")


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return _matching(a, b, "left_semi")


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION: by position, duplicates stay, names of the first."""
    for df in others:
        if len(df.columns) != len(first.columns):
            raise ValueError("tables of different width")
        first = first.union(df)
    return first


def cross_join(first: DataFrame, *others: DataFrame) -> DataFrame:
    """CROSSJOIN: each row with each. Its size is the product of the sizes: for small tables of values."""
    for df in others:
        if clash := set(first.columns) & set(df.columns):
            raise ValueError(f"columns in both tables: {sorted(clash)}")
        first = first.crossJoin(df)
    return first


def generate(a: DataFrame, b: Callable[[], DataFrame]) -> DataFrame:
    """GENERATE: for each row of a the rows of b, which refers to a's columns by F.col(name).outer(); none: the row goes."""
    return a.lateralJoin(b())


def values(df: DataFrame, column: str) -> DataFrame:
    """VALUES, DISTINCT and FILTERS of a column; text without case, in its first spelling."""
    if dict(df.dtypes)[column] != "string":
        return df.select(column).distinct()
    return df.groupBy(F.lower(column).alias("__key")).agg(F.min(column).alias(column)).drop("__key")


def distinct_rows(df: DataFrame) -> DataFrame:
    """DISTINCT of a table: text compares without case, the least spelling of each row stays."""
    keys = [F.lower(n).alias(f"__{n}") if k == "string" else F.col(n).alias(f"__{n}") for n, k in df.dtypes]
    return df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("__row")).select("__row.*")


def select_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def add_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def summarize(model: Model, table: str, groups: list[str], **aggregates: Column) -> DataFrame:
    """SUMMARIZE: group tuples that exist in the table, then each expression; blank rows stay."""
    return model.related(table, groups, how="inner").groupBy(*groups).agg(*(a.alias(n) for n, a in aggregates.items()))


def related_table(one: DataFrame, many: DataFrame, one_key: str, many_key: str, **aggregates: Column) -> DataFrame:
    """RELATEDTABLE under an aggregate: each row of the one side with what its rows of the many side add up to."""
    sums = many.groupBy(F.col(many_key).alias("__key")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return one.join(sums, F.col(one_key).eqNullSafe(F.col("__key")), "left").drop("__key")


def data_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """DATATABLE: rows of literals."""
    return spark.createDataFrame(rows, schema)


def series(spark: SparkSession, start: float, end: float, step: float = 1) -> DataFrame:
    """GENERATESERIES: both ends belong to it; a step down counts down; at most 100,000 rows."""
    n = int((end - start) / step + 1e-9) + 1 if step else 0
    if not step or n > 100_000:
        raise ValueError("a step of 0, or a series of more than 100,000 rows")
    return spark.range(max(0, n)).select((F.lit(start) + F.col("id") * F.lit(step)).alias("Value"))


def dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """CALENDAR: a row for each day, both ends included."""
    if not start or not end or start > end:
        raise ValueError("bounds are blank or reversed")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("Date"))


def calendar(df: DataFrame, column: str) -> DataFrame:
    """CALENDARAUTO: a row for each day of the whole years that a date column covers."""
    bounds = df.agg(F.trunc(F.min(column), "year").alias("a"), F.last_day(F.add_months(F.trunc(F.max(column), "year"), 11)).alias("b"))
    days = bounds.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("Date"))
    return days.select("Date", F.year("Date").alias("year"), F.quarter("Date").alias("quarter"), F.month("Date").alias("month"))


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], result: str, alternative=None) -> DataFrame:
    """LOOKUPVALUE: keys map columns of df to columns of the table; the one distinct result (BLANK is a result too),
    the alternative if there is none or are several. Text compares without case."""
    kinds = dict(table.dtypes)
    fold = lambda c, own: F.lower(c) if kinds[own] == "string" else F.col(c)
    n = F.countDistinct(result) + F.max(F.col(result).isNull().cast("int"))
    one = table.groupBy(*(fold(t, t).alias(f"__{t}") for t in keys.values())).agg(F.min(result).alias(result), n.alias("__n"))
    on = F.lit(True)
    for own, t in keys.items():
        on = on & fold(own, t).eqNullSafe(F.col(f"__{t}"))
    found = F.when(F.col("__n") == 1, F.col(result)).otherwise(F.lit(alternative))
    return df.join(one, on, "left").select(*df.columns, found.alias(result))


def concatenated(df: DataFrame, groups: list[str], value: str, delimiter: str, order: str) -> DataFrame:
    """CONCATENATEX over groups of bounded size."""
    return df.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), delimiter).alias("text"))


def domains(df: DataFrame, columns: list[str], limit: int = 2500) -> DataFrame:
    """(position, value): the first distinct values of several columns, in one pass over the table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns))))
    each = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("position", F.lower("value").alias("__k")).agg(F.min("value").alias("value"))
    w = Window.partitionBy("position").orderBy("value")
    return each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).select("position", "value")


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each column has, in one pass and one row: text without case, BLANK as a value of its own."""
    blank = lambda c: F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))
    return df.agg(*((F.countDistinct(F.lower(F.col(c).cast("string"))) + blank(c)).alias(c) for c in columns))


def catalog(model: Model) -> dict[str, DataFrame]:
    """INFO.VIEW tables of a model: its tables, columns, measures and relationships."""
    spark = next(iter(model.tables.values())).sparkSession
    columns = [(t, c, k) for t in model.tables for c, k in model.tables[t].dtypes]
    measures = [(n, getattr(m, "fact", None), ", ".join(getattr(m, "inputs", ()))) for n, m in model.measures.items()]
    relations = [(r.many, r.many_key, r.one, r.one_key, r.active, r.role) for r in model.relationships]
    return {
        "tables": spark.createDataFrame([(t,) for t in model.tables], "name string"),
        "columns": spark.createDataFrame(columns, "table string, name string, type string"),
        "measures": spark.createDataFrame(measures, "name string, fact string, inputs string"),
        "relationships": spark.createDataFrame(relations, "many string, many_key string, one string, one_key string, active boolean, role string"),
    }


def first_rows(df: DataFrame, n: int, value: str, keys: list[str], largest: bool = True) -> DataFrame:
    """The n rows with the largest or smallest values and no more: ties are cut by the keys, blanks count as least."""
    by = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_first()
    return df.orderBy(by, *keys).limit(n)


def blank_share(df: DataFrame, key: str, value: str, least: float = 0.5) -> DataFrame:
    """blank, total and share of a total that has no key, if the share is at least `least`: else no row, as where the
    total is not above 0 or a group's value is below 0. A key of spaces is blank."""
    groups = df.groupBy(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("__k")).agg(F.sum(value).alias("__v"))
    out = groups.agg(F.sum(F.when(F.col("__k").isNull(), F.col("__v")).otherwise(0)).alias("blank"), F.sum("__v").alias("total"), F.min("__v").alias("__least"))
    out = out.where((F.col("total") > 0) & (F.col("__least") >= 0)).withColumn("share", F.col("blank").cast("double") / F.col("total").cast("double"))
    return out.where(F.col("share") >= least).select("blank", "total", "share")


#: Texts that stand for no value.
NO_VALUE = ["", "blank", "none", "nan", "null", "(en blanco)"]


def listed(df: DataFrame, column: str, cap: int) -> DataFrame:
    """The first values of a column in order, trimmed and told apart without case; how many there are in all, and whether
    the list is cut."""
    text = F.trim(F.col(column).cast("string"))
    found = df.select(text.alias("value")).where(F.col("value").isNotNull() & ~F.lower("value").isin(*NO_VALUE))
    found = found.groupBy(F.lower("value").alias("__low")).agg(F.min("value").alias("value"))
    size = found.agg(F.count("*").alias("total"))  # one row
    first = found.orderBy("__low").limit(cap).select("value")
    return first.crossJoin(F.broadcast(size)).withColumn("is_cut", F.col("total") > cap)
