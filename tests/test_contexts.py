"""Periods of measures against plain Python, spines, inspections and tables as filters on small models."""

import calendar
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lucerna.operators import model as M
from lucerna.operators import periods as P


def add_months(d, n):
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def moved(d, n, unit):
    return d + timedelta(n) if unit == "day" else add_months(d, n * P.MONTHS[unit])


def unit_of(d, unit):
    if unit == "day":
        return d, d
    size = P.MONTHS[unit]
    start = date(d.year, (d.month - 1) // size * size + 1, 1)
    return start, add_months(start, size) - timedelta(1)


def plain_dates(seen, days, p):
    """The set of dates of one group."""
    if not seen:
        return set()
    low, high = min(seen), max(seen)
    if p.kind == "shift":
        out = set()
        for first in {d.replace(day=1) for d in seen}:
            own = [d for d in seen if d.replace(day=1) == first]
            if p.unit != "day" and len(own) == calendar.monthrange(first.year, first.month)[1]:
                to = moved(first, p.n, p.unit)
                out |= {to + timedelta(k) for k in range(calendar.monthrange(to.year, to.month)[1])}
            else:
                out |= {moved(d, p.n, p.unit) for d in own}
        return out & days
    if p.kind == "to_date":
        a, b = unit_of(high, p.unit)[0], high
    elif p.kind == "before":
        a, b = unit_of(moved(low, p.n, p.unit), p.unit)
    elif p.kind == "after":
        a, b = unit_of(moved(high, p.n, p.unit), p.unit)
    elif p.kind == "parallel":
        a, b = unit_of(moved(low, p.n, p.unit), p.unit)[0], unit_of(moved(high, p.n, p.unit), p.unit)[1]
    elif p.kind == "window":
        at = date.fromisoformat(p.start) if p.start else high
        a, b = (moved(at, p.n, p.unit) + timedelta(1), at) if p.n < 0 else (at, moved(at, p.n, p.unit) - timedelta(1))
    elif p.kind == "between":
        a, b = (date.fromisoformat(x) if x else y for x, y in ((p.start, date.min), (p.end, date.max)))
    elif p.kind in ("first", "last"):
        a = b = low if p.kind == "first" else high
    else:
        a, b = unit_of(low if p.kind == "start" else high, p.unit)
        inside = [d for d in days if a <= d <= b]
        return {min(inside) if p.kind == "start" else max(inside)} if inside else set()
    return {d for d in days if a <= d <= b}


#: A calendar with holes: no 29 February, no June of the first year; groups cut months in two.
DAYS = {date(2020, 1, 1) + timedelta(k) for k in range(1100)} - {date(2020, 2, 29)} - {date(2020, 6, 1) + timedelta(k) for k in range(30)}
KINDS = [
    P.to_date("d"), P.to_date("d", "quarter"), P.to_date("d", "month"), P.date_add("d", -1, "month"), P.date_add("d", 1, "quarter"), P.date_add("d", -10, "day"), P.same_period_last_year("d"), P.previous("d", "day"), P.previous("d", "month"), P.previous("d", "quarter"), P.previous("d", "year"),
    P.following("d", "day"), P.following("d", "month"), P.following("d", "quarter"), P.following("d", "year"), P.parallel("d", -1, "quarter"), P.parallel("d", 1, "month"), P.window("d", -3, "month"), P.window("d", -10, "day"), P.window("d", 2, "month", "2020-05-15"), P.between("d", "2021-01-10", "2021-02-03"),
    P.between("d", None, "2020-03-01"), P.between("d", "2022-12-01", None), P.edge("d", "first"), P.edge("d", "last"), P.edge("d", "start", "month"), P.edge("d", "end", "month"), P.edge("d", "start", "quarter"), P.edge("d", "end", "year"),
]


def test_sets_of_dates(spark):
    groups = {"half": {date(2021, 3, k) for k in range(5, 20)}, "month": {d for d in DAYS if (d.year, d.month) == (2021, 3)}, "year": {d for d in DAYS if d.year == 2021}, "gap": {date(2020, 7, 31), date(2020, 12, 30), date(2020, 12, 31)}, "leap": {date(2021, 2, k) for k in range(1, 29)}, "one": {date(2020, 1, 31)}}
    seen = spark.createDataFrame([(g, d) for g, own in groups.items() for d in own] + [(None, date(2021, 5, 31))], "g string, d date").cache()
    groups[None] = {date(2021, 5, 31)}
    days = spark.createDataFrame([(d,) for d in DAYS], "d date").cache()
    for p in KINDS:
        got = {}
        for r in P.dates_of(seen, days, ["g"], "d", p).collect():
            assert r["d"] not in got.setdefault(r["g"], set())
            got[r["g"]].add(r["d"])
        assert got == {g: s for g, own in groups.items() if (s := plain_dates(own, DAYS, p))}, p
    assert P.dates_of(seen.limit(0), days, ["g"], "d", KINDS[0]).collect() == []


@pytest.fixture(scope="module")
def sales(spark):
    days = spark.createDataFrame([(d, d.year, d.month) for d in DAYS], "d date, y int, m int")
    rows = [(date(2020, 1, 1) + timedelta(k * 7 % 1100), f"s{k % 3}", k % 11, "ab"[k % 2]) for k in range(900)] + [(None, "s1", 5, "a"), (date(2021, 3, 3), None, 3, "a"), (date(2020, 2, 29), "s2", 100, "b")]
    sale = spark.createDataFrame(rows, "day date, shop string, worth int, kind string")
    shop = spark.createDataFrame([("S0", "x"), ("s1", "x"), ("s2", "y"), ("s9", "y")], "s string, town string")
    m = M.Model({"sale": sale, "days": days, "shop": shop}, [M.Relationship("sale", "day", "days", "d"), M.Relationship("sale", "shop", "shop", "s")], {"worth": M.total("sale", "worth"), "kinds": M.distinct_count("sale", "kind")})
    return m, rows


def test_measures_over_periods(sales):
    """Sums and distinct counts over each kind of period, by month and town, under filters of calendar and shop."""
    m, rows = sales
    towns = {"s0": "x", "s1": "x", "s2": "y"}
    for k in range(0, len(KINDS), 5):
        kinds = {f"p{k + i}": p for i, p in enumerate(KINDS[k : k + 5])}
        extra = {n: M.over(m.measures["worth"], p) for n, p in kinds.items()} | {"kinds_over": M.over(m.measures["kinds"], KINDS[k])}
        c = M.Context().calculate("y", F.col("y") == 2021).calculate("m", F.col("m").isin(2, 3, 12)).calculate("s", F.col("s") != "s1")
        got = {(r["m"], r["town"]): r.asDict() for r in m.query(["m", "town"], [*extra], c, extra).collect()}
        want = {}
        for month in (2, 3, 12):
            seen = {d for d in DAYS if (d.year, d.month) == (2021, month)}
            for town in "xy":
                own = [r for r in rows if r[1] and r[1].lower() != "s1" and towns[r[1].lower()] == town and r[0] in DAYS]
                row = {n: [r for r in own if r[0] in plain_dates(seen, DAYS, p)] for n, p in kinds.items()}
                out = {n: sum(r[2] for r in some) if some else None for n, some in row.items()}
                out["kinds_over"] = len({r[3] for r in own if r[0] in plain_dates(seen, DAYS, KINDS[k])}) or None
                if any(v is not None for v in out.values()):
                    want[month, town] = {"m": month, "town": town, **out}
        assert got == want, k


def test_period_needs_columns_of_its_calendar(sales):
    m, _ = sales
    with pytest.raises(ValueError):
        m.query(["at=m@role"], ["w"], extra={"w": M.over(m.measures["worth"], P.to_date("d"))})


def test_group_values_exist_under_the_context(sales):
    """A period reaches other years, but a group of the fact's own column has to be there in the year asked for."""
    m, rows = sales
    extra = {"before": M.over(m.measures["worth"], P.same_period_last_year("d"))}
    c = M.Context().calculate("d", F.col("d") == F.lit("2021-03-03").cast("date"))
    got = {r["shop"]: r["before"] for r in m.query(["shop"], ["before"], c, extra).collect()}
    here = {r[1] for r in rows if r[0] == date(2021, 3, 3)}
    assert set(got) <= here


def test_inspections(spark):
    tables = {"shop": spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), (None, None)], "s string, town string"), "sale": spark.createDataFrame([("a", 1), ("c", 2)], "shop string, worth int"), "other": spark.createDataFrame([(1,)], "o int")}
    m = M.Model(tables, [M.Relationship("sale", "shop", "shop", "s")], {"worth": M.total("sale", "worth")})
    looks = {"f": M.Inspection("filtered", "town"), "t": M.Inspection("filtered", "shop"), "x": M.Inspection("cross", "sale"), "o": M.Inspection("cross", "other"), "one": M.Inspection("one filter", "s"), "scope": M.Inspection("scope", "town")}
    got = {r["town"]: tuple(r)[1:] for r in m.query(["town"], [*looks, "worth"], extra=looks).collect()}
    assert got == {"x": (True, True, True, False, False, True, 1), "y": (True, True, True, False, False, True, 2), None: (True, True, True, False, False, True, None)}
    got = m.query([], list(looks), M.Context().calculate("s", F.col("s") == "c"), looks).collect()
    assert [tuple(r) for r in got] == [(False, True, True, False, True, False)]
    both = replace(m.relationships[0], both=True)
    m.relationships = [both]
    assert [r["x"] for r in m.query([], ["x"], M.Context().calculate("worth", F.col("worth") == 1), {"x": M.Inspection("cross", "shop")}).collect()] == [True]


def test_treat_as_tables(spark):
    sale = spark.createDataFrame([("A", 1, 10), ("b", 1, 20), (None, 2, 40), ("b", None, 80)], "k string, n int, w int")
    m = M.Model({"sale": sale}, [], {"w": M.total("sale", "w")})
    ask = lambda columns, rows: [r["w"] for r in m.query([], ["w"], M.Context().treat_as(columns, rows)).collect()]
    assert ask(("k", "n"), spark.createDataFrame([("a", 1), ("B", 1), ("a", 1)], "x string, y long")) == [30]
    assert ask(("k",), spark.createDataFrame([(None,)], "x string")) == [40] and ask(("n",), spark.createDataFrame([("1",)], "x string")) == []
    assert ask(("n",), spark.createDataFrame([(None,)], "x string")) == [80]
    with pytest.raises(ValueError):
        M.Context().treat_as(("k", "n"), spark.createDataFrame([("a",)], "x string"))


def test_spine_under_the_whole_context(spark):
    tables = {"town": spark.createDataFrame([("x", "r1"), ("y", "r1"), ("z", "r2")], "t string, r string"), "region": spark.createDataFrame([("r1",), ("r2",)], "name string"), "part": spark.createDataFrame([(1,), (2,)], "p int")}
    m = M.Model(tables, [M.Relationship("town", "r", "region", "name")], {"parts": M.count_rows("part")})
    got = m.query(["t"], ["parts"], M.Context().calculate("name", F.col("name") == "r1")).collect()
    assert sorted(tuple(r) for r in got) == [("x", 2), ("y", 2)]
    M.MOST_COMBINATIONS, was = 5, M.MOST_COMBINATIONS
    try:
        with pytest.raises(ValueError, match="more than 5"):
            m.query(["t", "name", "p"], ["parts"], extra={"parts": M.total("region", F.lit(1))})
    finally:
        M.MOST_COMBINATIONS = was
