"""Semantic models: tables, relationships and named measures; queries evaluate measures in a filter context.

A query becomes one aggregation for each fact table and set of group keys: the dimensions that its groups and filters
need are joined along many-to-one relationships, so Catalyst prunes columns, pushes filters down and picks the joins.
Joins are null-safe and compare text without case; fact rows without a dimension row fall out where it groups or
filters. Parts are merged on their group keys, null-safe. A measure that a group key can't narrow (another fact's
dimension, a removed or replaced filter) repeats its value over that key's values. Blank measures (nothing to aggregate)
are null; rows in which all are blank go. A relationship of both directions lets a filter on its many side narrow its one
side, by semi joins on keys; group keys go from many to one only.

A measure over a period (year to date, the year before, ...) sees other dates than its group: the dates that the calendar
shows in the group are mapped to a set of dates, which takes the place of all filters on the calendar. Facts are added up
by day first where values of days combine (sums, counts, least, greatest), so that what meets the sets is a row for each
day and group, not a fact's row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import Period, dates_of

#: Combinations of group values of several tables that a query may cross.
MOST_COMBINATIONS = 200_000


@dataclass(frozen=True)
class Relationship:
    many: str
    many_key: str
    one: str
    one_key: str
    active: bool = True
    role: str | None = None
    both: bool = False


@dataclass(frozen=True)
class Measure:
    """An aggregate over a fact's columns. where: filters that replace those on their columns (CALCULATE), keep: filters
    that stand beside them (KEEPFILTERS), ignores: columns whose filters go (ALL, REMOVEFILTERS), selected: columns whose
    group keys go and whose filters stay (ALLSELECTED), uses: a role, period: the dates that it sees instead of its
    group's, merge: how the values of parts of the rows combine, if they do."""

    fact: str
    aggregate: Callable[[Column | None], Column]
    where: Mapping[str, Column] = field(default_factory=dict)
    keep: Mapping[str, Column] = field(default_factory=dict)
    ignores: frozenset[str] = frozenset()
    uses: str | None = None
    selected: frozenset[str] = frozenset()
    period: Period | None = None
    merge: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Derived:
    """A measure of measures, evaluated in each row."""

    inputs: tuple[str, ...]
    combine: Callable[..., Column]


@dataclass(frozen=True)
class Inspection:
    """ISFILTERED (a column or table), ISCROSSFILTERED (a table), HASONEFILTER and ISINSCOPE (a column): what filters and
    group keys act on it. Never blank, so a query with one has a row for each combination of its groups."""

    kind: str
    of: str


@dataclass(frozen=True)
class Context:
    """Predicates, or tables of allowed values, by the columns that they are on. A new filter on columns replaces the old
    one unless kept."""

    filters: tuple[tuple[tuple[str, ...], Column | DataFrame], ...] = ()

    def calculate(self, column: str | tuple[str, ...], predicate: Column | DataFrame, keep: bool = False) -> Context:
        columns = (column,) if isinstance(column, str) else column
        rest = self.filters if keep else tuple(f for f in self.filters if f[0] != columns)
        return replace(self, filters=(*rest, (columns, predicate)))

    def remove(self, *columns: str) -> Context:
        """Filters go whose columns are all among these."""
        return replace(self, filters=tuple(f for f in self.filters if not set(f[0]) <= set(columns)))

    def treat_as(self, columns: tuple[str, ...], rows: list[tuple] | DataFrame, keep: bool = False) -> Context:
        """TREATAS: the columns take the values of one of the rows; text without case, BLANK equals BLANK. A table's rows
        act by a semi join; a value of another type than its column's equals none."""
        if isinstance(rows, DataFrame):
            if len(rows.columns) != len(columns):
                raise ValueError(f"{len(columns)} columns can't take the values of {len(rows.columns)}")
            return self.calculate(columns if len(columns) > 1 else columns[0], rows, keep)
        fits = F.lit(False)
        for row in rows:
            one = F.lit(True)
            for c, v in zip(columns, row, strict=True):
                one = one & (F.lower(c).eqNullSafe(F.lit(v.lower())) if isinstance(v, str) else F.col(c).eqNullSafe(F.lit(v)))
            fits = fits | one
        return self.calculate(columns if len(columns) > 1 else columns[0], fits, keep)

    def is_filtered(self, *columns: str) -> bool:
        """ISFILTERED: a filter on one of the columns itself."""
        return any(set(f[0]) & set(columns) for f in self.filters)


@dataclass(frozen=True)
class Key:
    """A group key: `column`, `alias=column`, or `alias=column@role` for a dimension in one of its roles."""

    alias: str
    column: str
    role: str | None = None

    @classmethod
    def of(cls, text: str) -> Key:
        alias, _, rest = text.rpartition("=")
        column, _, role = rest.partition("@")
        return cls(alias or column, column, role or None)


class Tables(Mapping):
    """Tables that are opened when first asked for. owners: prefixes of column names by table."""

    def __init__(self, names: list[str], read: Callable[[str], DataFrame], owners: dict[str, str] | None = None):
        self.names, self.read, self.owners, self.opened = names, read, owners or {}, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.opened:
            self.opened[name] = self.read(name)
        return self.opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


@dataclass
class Model:
    tables: Mapping[str, DataFrame]
    relationships: list[Relationship] = field(default_factory=list)
    measures: dict[str, Measure | Derived] = field(default_factory=dict)

    def table_of(self, column: str) -> str:
        for prefix, name in getattr(self.tables, "owners", {}).items():
            if column.startswith(prefix) and column in self.tables[name].columns:
                return name
        for name, df in self.tables.items():
            if column in df.columns:
                return name
        raise KeyError(f"no table has {column}")

    def edges(self, uses: str | None = None) -> list[Relationship]:
        """The relationships that act; a role's take the place of the active ones into the same table."""
        ends = {r.one for r in self.relationships if uses and r.role == uses}
        return [r for r in self.relationships if (uses and r.role == uses) or (r.active and r.one not in ends)]

    def narrowed(self, table: str, filters: list[tuple[tuple[str, ...], Column]], uses: str | None = None, seen: frozenset[str] = frozenset()) -> DataFrame | None:
        """The table's rows that filters on it and on the tables around it leave; None if no filter gets here. A table
        is narrowed by all its own neighbours before it narrows the next one, and no way passes a table twice. Filters
        on columns of several tables are left out."""
        df, hit, seen = self.tables[table], False, seen | {table}
        for columns, predicate in filters:
            if all(self.table_of(c) == table for c in columns):
                df, hit = filtered(df, columns, predicate), True
        for r in self.edges(uses):
            ways = [(r.many, r.many_key, r.one, r.one_key)] + ([(r.one, r.one_key, r.many, r.many_key)] if r.both else [])
            for here, own, there, key in ways:
                rows = self.narrowed(there, filters, uses, seen) if here == table and there not in seen else None
                if rows is not None:
                    text = dict(rows.dtypes)[key] == "string"
                    df, hit = df.join(rows.select(F.col(key).alias("__to")), equal_keys(own, "__to", text), "left_semi"), True
        return df if hit else None

    def path(self, fact: str, table: str, uses: str | None = None) -> list[Relationship] | None:
        """The many-to-one steps from a fact to a table, shortest first; None if they are not related. A role's
        relationship takes the place of the active ones into the same table."""
        edges = self.edges(uses)
        queue, seen = [(fact, [])], {fact}
        while queue:
            at, steps = queue.pop(0)
            if at == table:
                return steps
            for r in edges:
                if r.many == at and r.one not in seen:
                    seen.add(r.one)
                    queue.append((r.one, [*steps, r]))
        return None

    def reaches(self, fact: str, column: str, uses: str | None = None) -> bool:
        return self.path(fact, self.table_of(column), uses) is not None

    def expanded(self, table: str) -> frozenset[str]:
        """The columns of a table and of all that it leads to, many to one."""
        return frozenset(c for t in self.tables if self.path(table, t) is not None for c in self.tables[t].columns)

    def all_except(self, table: str, *keep: str) -> frozenset[str]:
        """ALLEXCEPT, as a measure's `ignores`."""
        return self.expanded(table) - set(keep)

    def cross_filtered(self, context: Context, table: str, groups: Iterable[str] = ()) -> bool:
        """ISCROSSFILTERED: a filter or group key on the table, or on one that narrows it."""
        touched = {self.table_of(c) for columns, _ in context.filters for c in columns} | {self.table_of(Key.of(g).column) for g in groups}
        seen, queue = {table}, [table]
        while queue:
            at = queue.pop()
            ways = [r.one for r in self.edges() if r.many == at] + [r.many for r in self.edges() if r.one == at and r.both]
            queue += [t for t in ways if t not in seen]
            seen |= set(ways)
        return bool(seen & touched)

    def is_filtered(self, context: Context, of: str, groups: Iterable[str] = ()) -> bool:
        """ISFILTERED: a filter or group key on the column, or on a column of the table."""
        acting = {c for columns, _ in context.filters for c in columns} | {Key.of(g).column for g in groups}
        return any(self.table_of(c) == of for c in acting) if of in self.tables else of in acting

    def calculate_table(self, table: str, context: Context) -> DataFrame:
        """CALCULATETABLE: the rows of a table that the context shows."""
        rows = self.narrowed(table, list(context.filters))
        return self.tables[table] if rows is None else rows

    def visible(self, context: Context, *columns: str) -> DataFrame:
        """VALUES under a context: the distinct values of columns of one table that it shows."""
        return self.calculate_table(self.table_of(columns[0]), context).select(*columns).distinct()

    def related(self, fact: str, columns: list[str | Key], uses: str | None = None, how: str = "left", rows: DataFrame | None = None) -> DataFrame:
        """The fact, or these rows of it, with the columns (RELATED) of its dimensions; keys in a role come under their
        alias."""
        df, joined = self.tables[fact] if rows is None else rows, {}
        for key in (Key.of(c) if isinstance(c, str) else c for c in columns):
            role = key.role or uses
            prefix = f"__{key.role}__" if key.role else ""
            if not prefix and key.column in df.columns:
                continue
            steps = self.path(fact, self.table_of(key.column), role)
            if steps is None:
                raise ValueError(f"{key.column} is not related to {fact}")
            for r in steps:
                if (prefix, r.one) not in joined:
                    one = self.tables[r.one]
                    many_key = prefix + r.many_key if (prefix, r.many) in joined else r.many_key
                    joined[prefix, r.one] = True
                    text = dict(one.dtypes)[r.one_key] == "string"
                    one = one.select(*(F.col(c).alias(prefix + c) for c in one.columns), F.col(r.one_key).alias("__to"))
                    df = df.join(one, equal_keys(many_key, "__to", text), how).drop("__to")
            if prefix:
                df = df.withColumn(key.alias, F.col(prefix + key.column))
        return df

    def inputs(self, names: list[str], known: dict) -> list[str]:
        """The measures with an aggregate that these need."""
        out: dict[str, None] = {}
        for n in names:
            out |= dict.fromkeys(self.inputs(list(known[n].inputs), known) if isinstance(known[n], Derived) else [n])
        return list(out)

    def value(self, name: str, known: dict) -> Column:
        x = known[name]
        return x.combine(*(self.value(i, known) for i in x.inputs)) if isinstance(x, Derived) else F.col(name)

    def spine(self, keys: list[Key], context: Context) -> DataFrame:
        """The combinations of key values: those that exist in a table's rows under the whole context, each with each
        between tables, as far as they are at most `MOST_COMBINATIONS`."""
        out, by_table, sizes = None, {}, 1
        for k in keys:
            by_table.setdefault((self.table_of(k.column), k.role), []).append(k)
        for (table, role), own in by_table.items():
            rows = self.narrowed(table, list(context.filters), role)
            df = (self.tables[table] if rows is None else rows).select(*(F.col(k.column).alias(k.alias) for k in own)).distinct()
            if len(by_table) > 1:
                sizes *= df.limit(MOST_COMBINATIONS + 1).count()
                if sizes > MOST_COMBINATIONS:
                    raise ValueError(f"groups of {len(by_table)} tables have more than {MOST_COMBINATIONS} combinations")
            out = df if out is None else out.crossJoin(df)
        return out

    def inspected(self, name: str, x: Inspection, groups: list[str], context: Context) -> dict[str, Measure | Derived]:
        """An inspection as measures: what acts is known from the query, whether one value is left from the rows."""
        acts = self.cross_filtered(context, x.of, groups) if x.kind == "cross" else self.is_filtered(context, x.of, groups)
        if x.kind in ("filtered", "cross") or not acts:
            return {name: Derived((), lambda: F.lit(acts))}
        one = has_one_value(self.table_of(x.of), x.of)
        return {name: Derived((f"__one_{name}",), lambda v: F.coalesce(v, F.lit(False))), f"__one_{name}": one}

    def part(self, fact: str, names: list[str], known: dict, keys: list[Key], context: Context, uses: str | None) -> DataFrame:
        """The measures of one fact that see the same rows, by these keys."""
        left = context.filters
        filters = [(c, p) for c, p in left if all(self.reaches(fact, x, uses) for x in c)]
        more = [c for n in names for c in (*known[n].where, *known[n].keep)]
        far = len(filters) < len(left) and any(r.both for r in self.edges(uses))
        df = self.related(fact, [*keys, *(x for c, _ in filters for x in c), *more], uses, "inner", self.narrowed(fact, list(left), uses) if far else None)
        for columns, predicate in filters:
            df = filtered(df, columns, predicate)
        return df.groupBy(*(k.alias if k.role else F.col(k.column).alias(k.alias) for k in keys)).agg(*(known[m].aggregate(own_filter(known[m])).alias(m) for m in names))

    def period_part(self, fact: str, names: list[str], known: dict, keys: list[Key], context: Context, uses: str | None) -> DataFrame:
        """As `part`, of measures that see periods of one calendar instead of the dates of their group. If their values of
        days combine, facts are added up once by day for all of them, and the days meet the sets of all periods at once;
        else (counts of distinct values, medians) they have one period, and rows meet its sets."""
        column = known[names[0]].period.column
        calendar = self.table_of(column)
        own = [k for k in keys if self.table_of(k.column) == calendar]
        rest = [k for k in keys if self.table_of(k.column) != calendar]
        for k in keys:
            if k in own and k.role or k in rest and self.path(calendar, self.table_of(k.column)) is not None:
                raise ValueError(f"{k.alias}: a period's groups are columns of its calendar, without a role")
        shown = self.narrowed(calendar, list(context.filters), uses)
        day = F.col(column).cast("date").alias("__day")
        days = self.tables[calendar].select(day).where("__day is not null").distinct()
        seen = (self.tables[calendar] if shown is None else shown).select(*(F.col(k.column).alias(f"__of_{k.alias}") for k in own), day).where("__day is not null").distinct()
        periods, sets = list(dict.fromkeys(known[n].period for n in names)), None
        for i, period in enumerate(periods):
            one = dates_of(seen, days, [f"__of_{k.alias}" for k in own], "__day", period).withColumn("__period", F.lit(i))
            sets = one if sets is None else sets.unionByName(one)
        others = replace(context, filters=tuple(f for f in context.filters if all(self.table_of(c) != calendar for c in f[0])))
        if all(known[n].merge for n in names):
            same = {n: (id(known[n].aggregate), id(known[n].where), id(known[n].keep)) for n in names}
            first = {k: n for n, k in reversed(same.items())}
            by_day = self.part(fact, list(first.values()), known, [*rest, Key("__date", column)], others, uses)
            met = by_day.join(sets, F.col("__date").cast("date") == F.col("__day"))
            by = [F.col(f"__of_{k.alias}" if k in own else k.alias).alias(k.alias) for k in keys]
            out = met.groupBy(*by).agg(*(known[n].merge(F.when(F.col("__period") == periods.index(known[n].period), F.col(first[same[n]]))).alias(n) for n in names))
        else:
            filters = [(f, p) for f, p in others.filters if all(self.reaches(fact, c, uses) for c in f)]
            columns = [*rest, *(c for f, _ in filters for c in f), *(c for n in names for c in (*known[n].where, *known[n].keep)), column]
            far = len(filters) < len(others.filters) and any(r.both for r in self.edges(uses))
            df = self.related(fact, columns, uses, "inner", self.narrowed(fact, list(others.filters), uses) if far else None)
            for f, predicate in filters:
                df = filtered(df, f, predicate)
            df = df.join(sets, F.col(column).cast("date") == F.col("__day"))
            by = [F.col(f"__of_{k.alias}" if k in own else k.alias if k.role else k.column).alias(k.alias) for k in keys]
            out = df.groupBy(*by).agg(*(known[m].aggregate(own_filter(known[m])).alias(m) for m in names))
        gone = [f for f in context.filters if not any(f is g for g in others.filters)]
        return self.shown_only(out, rest, context, gone)

    def shown_only(self, df: DataFrame, keys: list[Key], context: Context, gone: list) -> DataFrame:
        """The rows whose keys the whole context shows, where a measure sees more than it: a group's value needs no row
        with data, but it has to exist in its table under the filters that the measure has done away with (`gone`)."""
        for table, role in dict.fromkeys((self.table_of(k.column), k.role) for k in keys):
            if all(self.path(table, self.table_of(c), role) is None for columns, _ in gone for c in columns):
                continue
            own = [k for k in keys if (self.table_of(k.column), k.role) == (table, role)]
            there = self.narrowed(table, list(context.filters), role)
            if there is not None:
                there = there.select(*(F.col(k.column).alias(f"__{k.alias}") for k in own)).distinct()
                on = F.lit(True)
                for k in own:
                    on = on & df[k.alias].eqNullSafe(there[f"__{k.alias}"])
                df = df.join(there, on, "left_semi")
        return df

    def query(self, groups: list[str], measures: list[str], context: Context = Context(), extra: dict[str, Measure | Derived | Inspection] | None = None) -> DataFrame:
        """SUMMARIZECOLUMNS: groups, and the measures in the context narrowed to each group."""
        known, keys = {**self.measures, **(extra or {})}, [Key.of(g) for g in groups]
        looks = [m for m in measures if isinstance(known[m], Inspection)]
        for m in looks:
            known |= self.inspected(m, known[m], groups, context)
        asked = {k.column for k in keys} | {c for columns, _ in context.filters for c in columns}
        base = self.inputs(measures, known)
        parts: dict[tuple, list[str]] = {}
        for m in base:
            x = known[m]
            period = x.period if x.period and self.reaches(x.fact, x.period.column, x.uses) else None
            together = period and (period.column if x.merge else period)
            parts.setdefault((x.fact, (x.ignores | set(x.where)) & asked, x.uses, x.selected & asked, together), []).append(m)
        whole, short = None, []
        for (fact, dropped, uses, selected, together), names in parts.items():
            own = [k for k in keys if k.column not in dropped | selected and self.reaches(fact, k.column, k.role or uses)]
            left = context.remove(*dropped)
            part = (self.period_part if together else self.part)(fact, names, known, own, left, uses)
            part = self.shown_only(part, own, context, [f for f in context.filters if not any(f is g for g in left.filters)])
            if len(own) < len(keys):
                short.append(([k.alias for k in own], part))
            else:
                whole = part if whole is None else merged(whole, part, [k.alias for k in keys], "full")
        aliases = [k.alias for k in keys]
        out = whole
        if keys and (short or looks or out is None):
            out = self.spine(keys, context)
            if whole is not None:
                out = merged(out, whole, aliases, "left")
        elif out is None:
            out = next(iter(self.tables.values())).sparkSession.range(1).select()
        for own, part in short:
            out = merged(out, part, own, "left")
        out = out.select(*aliases, *(self.value(m, known).alias(m) for m in measures))
        return out.where(F.coalesce(*(F.col(m).cast("string") for m in measures)).isNotNull())

    def iterated(self, outer: list[str], inner: list[str], measure: str, how: Mapping[str, Callable[[Column], Column]], context: Context = Context(), extra: dict | None = None) -> DataFrame:
        """SUMX, AVERAGEX, MEDIANX, MINX, MAXX, COUNTX over the values of `inner`: the measure of each once, then each of
        `how` under its name."""
        df = self.query([*outer, *inner], [measure], context, extra)
        return df.groupBy(*(Key.of(g).alias for g in outer)).agg(*(f(F.col(measure)).alias(n) for n, f in how.items()))

    def edge_nonblank(self, groups: list[str], column: str, measure: str, name: str, last: bool = True, context: Context = Context()) -> DataFrame:
        """LASTNONBLANK, FIRSTNONBLANK: the last or first value of the column at which the measure is not blank."""
        key = Key.of(column)
        df = self.query([*groups, column], [measure], context).where(F.col(measure).isNotNull())
        return df.groupBy(*(Key.of(g).alias for g in groups)).agg((F.max if last else F.min)(key.alias).alias(name))


def equal_keys(left: str, right: str, text: bool) -> Column:
    """Null equals null, and text is compared without case."""
    return F.lower(left).eqNullSafe(F.lower(right)) if text else F.col(left).eqNullSafe(F.col(right))


def kind_of(data_type: str) -> str:
    """What values of a type can equal."""
    if data_type.startswith(("date", "timestamp")):
        return "time"
    return data_type if data_type in ("string", "boolean") else "number"


def filtered(df: DataFrame, columns: tuple[str, ...], by: Column | DataFrame) -> DataFrame:
    """The rows that a filter leaves: a predicate's, or those whose columns equal a row of the table."""
    if isinstance(by, Column):
        return df.where(by)
    kinds, on = dict(df.dtypes), F.lit(True)
    rows = by.toDF(*(f"__v{i}" for i in range(len(columns)))).distinct()
    for (v, k), c in zip(rows.dtypes, columns, strict=True):
        if kind_of(k) == kind_of(kinds[c]):
            on = on & equal_keys(c, v, k == "string")
        else:
            on = on & F.col(c).isNull() & F.col(v).isNull()
    return df.join(rows, on, "left_semi")


def over(measure: Measure, period: Period) -> Measure:
    """The measure over a period: CALCULATE(measure, DATESYTD(...)), TOTALYTD(measure, ...) and the like."""
    return replace(measure, period=period)


def own_filter(measure: Measure) -> Column | None:
    out = None
    for p in (*measure.where.values(), *measure.keep.values()):
        out = p if out is None else out & p
    return out


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Merge on null-safe keys; without keys, the one row of totals beside every row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = None
    for k in keys:
        step = left[k].eqNullSafe(r[f"__{k}"])
        on = step if on is None else on & step
    rest = [c for c in left.columns if c not in keys]
    return left.join(r, on, how).select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), *rest, *(c for c in right.columns if c not in keys))


def _if(where: Column | None, x: Column) -> Column:
    return x if where is None else F.when(where, x)


def _of(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _none(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def _folded(column: str | Column) -> Column:
    return F.lower(_of(column).cast("string"))


def total(fact: str, column: str | Column, **more) -> Measure:
    """SUM, and SUMX of an expression over the fact's rows."""
    return Measure(fact, lambda w: F.sum(_if(w, _of(column))), **{"merge": F.sum, **more})


def average(fact: str, column: str | Column, **more) -> Measure:
    return Measure(fact, lambda w: F.avg(_if(w, _of(column))), **more)


def smallest(fact: str, column: str | Column, **more) -> Measure:
    return Measure(fact, lambda w: F.min(_if(w, _of(column))), **{"merge": F.min, **more})


def largest(fact: str, column: str | Column, **more) -> Measure:
    return Measure(fact, lambda w: F.max(_if(w, _of(column))), **{"merge": F.max, **more})


def median(fact: str, column: str | Column, **more) -> Measure:
    return Measure(fact, lambda w: F.median(_if(w, _of(column))), **more)


def count_rows(fact: str, **more) -> Measure:
    """No rows: BLANK."""
    return Measure(fact, lambda w: _none(F.count(_if(w, F.lit(1)))), **{"merge": F.sum, **more})


def count(fact: str, column: str | Column, **more) -> Measure:
    """COUNT, COUNTA, COUNTX: values that are not BLANK; none: BLANK."""
    return Measure(fact, lambda w: _none(F.count(_if(w, _of(column)))), **{"merge": F.sum, **more})


def count_blank(fact: str, column: str | Column, **more) -> Measure:
    """BLANK and empty texts."""
    return Measure(fact, lambda w: _none(F.count_if(_if(w, F.coalesce(_of(column).cast("string"), F.lit("")) == ""))), **more)


def distinct_count(fact: str, column: str | Column, blank: bool = True, **more) -> Measure:
    """BLANK counts as one value if blank (DISTINCTCOUNT, else DISTINCTCOUNTNOBLANK); text without case; none: BLANK."""
    blanks = lambda w: F.coalesce(F.max(_if(w, _of(column).isNull().cast("int"))), F.lit(0)) if blank else F.lit(0)
    return Measure(fact, lambda w: _none(F.countDistinct(_if(w, _folded(column))) + blanks(w)), **more)


def is_empty(fact: str, **more) -> Measure:
    return Measure(fact, lambda w: F.count(_if(w, F.lit(1))) == 0, **more)


def has_one_value(fact: str, column: str, **more) -> Measure:
    """HASONEVALUE: BLANK counts as a value."""
    n = lambda w: F.countDistinct(_if(w, _folded(column))) + F.coalesce(F.max(_if(w, F.col(column).isNull().cast("int"))), F.lit(0))
    return Measure(fact, lambda w: n(w) == 1, **more)


def selected_value(fact: str, column: str, alternative=None, **more) -> Measure:
    """SELECTEDVALUE: the one visible value, else the alternative."""
    one = has_one_value(fact, column)
    return Measure(fact, lambda w: F.when(one.aggregate(w), F.min(_if(w, F.col(column)))).otherwise(F.lit(alternative)), **more)


def ratio(fact: str, top: Column, bottom: Column, **more) -> Measure:
    """DIVIDE of two sums."""
    return Measure(fact, lambda w: F.try_divide(F.sum(_if(w, top)), _none(F.sum(_if(w, bottom)))), **more)
