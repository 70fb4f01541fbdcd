"""The star schema of the test tables as a model, with and without a calendar, and types that compare anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import model as M
from .operators import tables as T
from .sources.files import TABLES, parquet

MONEY = "decimal(18,4)"


def model(spark: SparkSession, d: str) -> M.Model:
    t = M.Tables(TABLES, lambda n: parquet(spark, d, n), {"l_": "lineitem", "o_": "orders", "c_": "customer", "p_": "part", "s_": "supplier", "n_": "nation", "r_": "region"})
    rel = M.Relationship
    relations = [
        rel("lineitem", "l_orderkey", "orders", "o_orderkey"), rel("orders", "o_custkey", "customer", "c_custkey"), rel("lineitem", "l_partkey", "part", "p_partkey"),
        rel("lineitem", "l_suppkey", "supplier", "s_suppkey"), rel("customer", "c_nationkey", "nation", "n_nationkey"), rel("nation", "n_regionkey", "region", "r_regionkey"),
        rel("supplier", "s_nationkey", "nation", "n_nationkey", False, "supplier nation"),
        rel("customer", "c_nationkey", "nation", "n_nationkey", False, "buyer nation"),
    ]
    price, net = F.col("l_extendedprice").cast(MONEY), F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(6,4)"))
    measures = {
        "revenue": M.total("lineitem", price), "net_revenue": M.total("lineitem", net), "quantity": M.total("lineitem", F.col("l_quantity").cast(MONEY)),
        "lines": M.count_rows("lineitem"), "returned_lines": M.count_rows("lineitem", where={"l_returnflag": F.col("l_returnflag") == "R"}),
        "orders_placed": M.count_rows("orders"), "order_value": M.total("orders", F.col("o_totalprice").cast(MONEY)), "buyers": M.distinct_count("orders", "o_custkey"),
        "first_shipment": M.smallest("lineitem", "l_shipdate"), "last_shipment": M.largest("lineitem", "l_shipdate"), "open_orders": M.count_rows("orders", where={"o_orderstatus": F.col("o_orderstatus") == "O"}),
        "all_revenue": M.total("lineitem", price, ignores=frozenset({"l_returnflag"})),
        "revenue_a_line": M.Derived(("revenue", "lines"), lambda a, b: F.round(S.divide(a, b), 6)), "share_returned": M.Derived(("returned_lines", "lines"), lambda a, b: F.round(S.divide(a, b), 9)),
    }
    return M.Model(t, relations, measures)


def dated_model(spark: SparkSession, d: str) -> M.Model:
    """The model with a calendar of the orders' whole years, which orders reach by their day, and order lines through
    their orders, or, as "shipped", by their own."""
    m = model(spark, d)
    owners = {**m.tables.owners, "cal_": "calendar"}

    def read(name: str) -> DataFrame:
        if name == "calendar":
            return T.calendar(parquet(spark, d, "orders"), "o_orderdate").toDF("cal_day", "cal_year", "cal_quarter", "cal_month").cache()  # some thousand rows
        df = parquet(spark, d, name)
        own = {"orders": ("o_day", "o_orderdate"), "lineitem": ("l_day", "l_shipdate")}.get(name)
        return df.withColumn(own[0], F.col(own[1]).cast("date")) if own else df

    rel = M.Relationship
    more = [rel("orders", "o_day", "calendar", "cal_day"), rel("lineitem", "l_day", "calendar", "cal_day", False, "shipped")]
    return M.Model(M.Tables([*TABLES, "calendar"], read, owners), [*m.relationships, *more], m.measures)


def plain_types(query):
    """Decimals as doubles and dates as text, so that results compare with any engine's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        kinds = {n: "double" for n, k in df.dtypes if k.startswith("decimal")} | {n: "string" for n, k in df.dtypes if k == "date"}
        return df.withColumns({n: F.col(n).cast(k) for n, k in kinds.items()})

    return run
