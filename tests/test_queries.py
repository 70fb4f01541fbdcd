"""Every query with SQL against DuckDB on the smallest tables, and the semantics of small cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lucerna import queries as Q
from lucerna.functions import scalars as S
from lucerna.operators import model as M
from lucerna.operators import tables as T
from lucerna.operators import time_intelligence as TI
from lucerna.streaming import events as E

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.execute(Q.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_blank_rules(spark):
    df = spark.createDataFrame([(None, 1.0, "A"), (2.0, None, "a"), (None, None, None), (5.0, 0.0, "Á")], "x double, y double, t string")
    x, y = F.col("x"), F.col("y")
    got = df.select(S.plus(x, y).alias("p"), S.divide(x, y).alias("d"), S.equal(x, F.lit(0.0), 0.0).alias("e"), S.same(x, y).alias("s"), S.negated(x > 3).alias("n")).collect()
    assert [tuple(r) for r in got] == [(1.0, None, True, False, True), (2.0, None, False, False, True), (None, None, True, True, True), (5.0, None, False, False, False)]
    assert sorted(str(r[0]) for r in T.values(df, "t").collect()) == ["A", "None", "Á"]


def test_both_directions(spark):
    """A filter on the many side narrows the one side only where the relationship goes both ways; text keys without
    case, null equals null; neighbours' filters meet on the same row."""
    tables = {
        "shop": spark.createDataFrame([("A", 1), ("b", 2), (None, 4), ("z", 8)], "s string, worth int"),
        "sale": spark.createDataFrame([("a", "x", 1), ("B", "x", 2), ("B", "y", 1), (None, "y", 2), ("q", "x", 2)], "shop string, item string, kind int"),
        "thing": spark.createDataFrame([("x", True), ("y", False)], "i string, big boolean"),
    }

    def worth(both, **filters):
        m = M.Model(tables, [M.Relationship("sale", "shop", "shop", "s", both=both), M.Relationship("sale", "item", "thing", "i")], {"worth": M.total("shop", F.col("worth"))})
        c = M.Context()
        for k, v in filters.items():
            c = c.calculate(k, F.col(k) == v)
        return [r["worth"] for r in m.query([], ["worth"], c).collect()]

    assert worth(False, kind=1) == [15] and worth(True, kind=1) == [3] and worth(True, kind=2) == [6]
    assert worth(True, big=True) == [3] and worth(True, big=True, kind=1) == [1] and worth(True, big=False, kind=2) == [4]
    assert worth(True, big=True, kind=9) == [] and worth(True, worth=2, kind=1) == [2]


def test_spans():
    assert [str(x) for x in TI.last_units("2024-03-31", 2, "semester")] == ["2023-01-01", "2024-01-01"]
    assert [str(x) for x in TI.last_units("2024-01-05", 1, "month")] == ["2023-12-01", "2024-01-01"]
    assert [str(x) for x in TI.last_units("2024-03-01", 2, "week")] == ["2024-02-17", "2024-03-02"]
    assert [str(x) for x in TI.default_units("2024-05-15", "year")] == ["2020-01-01", "2025-01-01"]
    assert [str(x) for x in TI.default_units("2024-05-15", "week")] == ["2024-03-25", "2024-05-16"]
    assert [str(x) for x in TI.default_units("2024-05-15", "quarter")] == ["2023-04-01", "2024-04-01"]


def test_blank_and_listed_edges(spark):
    df = spark.createDataFrame([(" ", 3), (None, 1), ("a", 4), ("A ", 0), ("null", 0), ("b", None)], "k string, v int")
    assert [tuple(r) for r in T.blank_share(df, "k", "v").collect()] == [(4, 8, 0.5)] and not T.blank_share(df, "k", "v", 0.6).collect()
    assert not T.blank_share(df.limit(0), "k", "v", 0.0).collect() and not T.blank_share(df.union(df.select("k", F.lit(-9))), "k", "v", 0.0).collect()
    assert [tuple(r) for r in T.listed(df, "k", 1).collect()] == [("A", 2, True)] and not T.listed(df.limit(0), "k", 1).collect()
    assert [r["k"] for r in T.first_rows(df, 2, "v", ["k"], largest=False).collect()] == ["b", "A "]


def test_ties_and_bags(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "k string, v int")
    assert sorted(r["k"] for r in T.top_n(df, 2, F.col("v")).collect()) == ["a", "b", "c"]
    left = spark.createDataFrame([(1,), (1,), (None,), (2,)], "x int")
    right = spark.createDataFrame([(2,), (None,)], "y int")
    assert [r[0] for r in T.except_rows(left, right).collect()] == [1, 1]
    assert sorted(map(str, (r[0] for r in T.intersect_rows(left, right).collect()))) == ["2", "None"]


def test_streams(spark):
    path = f"{SF}/events.parquet"
    batch = spark.read.parquet(path)
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = E.counted(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT string(start), event_type, n FROM counted").collect()}
    assert got == {tuple(r) for r in E.counted(batch).select(F.col("start").cast("string"), "event_type", "n").collect()}
