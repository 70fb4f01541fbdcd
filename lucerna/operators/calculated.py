"""Calculated columns: columns of columns, of related rows and of measures, laid out in layers over a model's tables.

A column names what it needs. Columns are sorted by their needs, a circle is refused; each layer of a table is one projection,
and what it needs of other tables comes by one join per table (many to one, as RELATED) or one aggregation per measure (the
rows of other tables that belong to the row, as a measure in row context). The model's tables become these frames, so that
queries prune what they do not ask for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import Context, Model, Tables


@dataclass(frozen=True)
class Calculated:
    """table.name = expression of the needed columns, which are the table's own, columns of tables that it leads to, other
    calculated columns of these, or measures (`key` is then the column that tells the table's rows apart)."""

    table: str
    name: str
    needs: tuple[str, ...]
    expression: Callable[..., Column]
    key: str | None = None


class CircularDependency(ValueError):
    pass


def layers(columns: list[Calculated]) -> list[list[Calculated]]:
    """Columns by layer: each needs only what comes from layers before its own."""
    by_name = {c.name: c for c in columns}
    if len(by_name) < len(columns):
        raise ValueError("two calculated columns of one name")
    depth: dict[str, int] = {}

    def of(name: str, way: tuple[str, ...]) -> int:
        if name in way:
            raise CircularDependency(" -> ".join((*way[way.index(name) :], name)))
        if name not in by_name:
            return -1
        if name not in depth:
            depth[name] = 1 + max((of(n, (*way, name)) for n in by_name[name].needs), default=-1)
        return depth[name]

    out: list[list[Calculated]] = []
    for c in columns:
        level = of(c.name, ())
        while len(out) <= level:
            out.append([])
        out[level].append(c)
    return out


def with_columns(model: Model, columns: list[Calculated]) -> Model:
    """The model with these columns in its tables."""
    tables = dict(getattr(model.tables, "opened", {}))
    now = replace(model, tables=_over(model, tables))
    for layer in layers(columns):
        done = {}
        for table in dict.fromkeys(c.table for c in layer):
            done[table] = _layer(now, table, [c for c in layer if c.table == table])
        tables = {**tables, **done}
        now = replace(model, tables=_over(model, tables))
    return now


def _over(model: Model, frames: dict) -> Tables:
    return Tables(list(model.tables), lambda n: frames[n] if n in frames else model.tables[n])


def _layer(model: Model, table: str, columns: list[Calculated]):
    df, own = model.tables[table], model.tables[table].columns
    needed = list(dict.fromkeys(n for c in columns for n in c.needs if n not in own))
    measures = [n for n in needed if n in model.measures]
    related = [n for n in needed if n not in model.measures]
    for n in related:
        if model.path(table, model.table_of(n)) is None:
            raise ValueError(f"{n} is not related to {table}")
    if related:
        df = model.related(table, related)
    if measures:
        keys = {c.key for c in columns if set(c.needs) & set(measures)}
        if len(keys) != 1 or None in keys:
            raise ValueError(f"columns of {table} with measures need one key")
        key = keys.pop()
        sums = model.query([f"__of={key}"], measures, Context())
        df = df.join(sums, df[key].eqNullSafe(sums["__of"]), "left").drop("__of")
    return df.select(*(df[c] for c in own), *(c.expression(*(F.col(n) for n in c.needs)).alias(c.name) for c in columns))
