"""Queries of filter contexts: periods of measures, tables as filters, inspection, spines, selections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import model as M
from ..operators import periods as P
from ..operators import tables as T
from ..sources.files import parquet
from ..star import MONEY, dated_model, model

DAY = "cal_day"


def _numbers(df, *names):
    """Counts that may be BLANK as doubles, as every engine hands them over."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _shares(m, *names):
    return {f"{n}_{k}": M.over(m.measures[n], p) for n in names for k, p in {"ytd": P.to_date(DAY), "last_year": P.same_period_last_year(DAY), "last_quarter": P.previous(DAY, "quarter")}.items()}


def period_measures(spark, d):
    """By month and nation, under a filter: a measure, its total since January, of the same month a year before and of the
    quarter before, and its growth."""
    m = dated_model(spark, d)
    extra = {**_shares(m, "order_value"), "growth": M.Derived(("order_value", "order_value_last_year"), lambda a, b: F.round(S.divide((a - b).cast("double"), b.cast("double")), 8))}
    c = M.Context().calculate("c_mktsegment", F.lower("c_mktsegment") == "building").calculate("cal_year", F.col("cal_year").between(1995, 1997))
    return m.query(["cal_year", "cal_month", "n_name"], ["order_value", *extra], c, extra)


def shifted_measures(spark, d):
    """By quarter under a filter on years: dates moved by months, whole periods before, after and around, and to date; the
    periods reach beyond the filter."""
    m = dated_model(spark, d)
    kinds = {
        "month_before": P.date_add(DAY, -1, "month"), "week_after": P.date_add(DAY, 7, "day"), "year_before": P.previous(DAY, "year"), "year_after": P.following(DAY, "year"), "month_after": P.following(DAY, "month"),
        "half_before": P.parallel(DAY, -2, "quarter"), "qtd": P.to_date(DAY, "quarter"), "mtd": P.to_date(DAY, "month"), "day_before": P.previous(DAY, "day"),
    }
    extra = {k: M.over(m.measures["orders_placed"], p) for k, p in kinds.items()}
    c = M.Context().calculate("cal_year", F.col("cal_year").isin(1996, 1997))
    return _numbers(m.query(["cal_year", "cal_quarter"], ["orders_placed", *extra], c, extra), "orders_placed", *extra)


def windowed_measures(spark, d):
    """The last three months and ninety days at each month, counts of distinct buyers too; a fixed span beside them."""
    m = dated_model(spark, d)
    last = P.window(DAY, -3, "month")
    extra = {
        "value_3m": M.over(m.measures["order_value"], last), "buyers_3m": M.over(m.measures["buyers"], last), "orders_90d": M.over(m.measures["orders_placed"], P.window(DAY, -90, "day")),
        "spring_1996": M.over(m.measures["orders_placed"], P.between(DAY, "1996-03-01", "1996-05-31")), "since_1998": M.over(m.measures["orders_placed"], P.between(DAY, "1998-01-01", None)), "from_may": M.over(m.measures["orders_placed"], P.window(DAY, 2, "month", "1995-05-01")),
    }
    return _numbers(m.query(["cal_year", "cal_month"], ["buyers", *extra], extra=extra), "buyers", *extra)


def edge_measures(spark, d):
    """What lies on the first and last dates of each quarter, its months and years: opening and closing values."""
    m = dated_model(spark, d)
    kinds = {"first": "first", "last": "last", "month_start": "start", "month_end": "end", "year_start": "start", "year_end": "end", "quarter_start": "start", "quarter_end": "end"}
    extra = {f"at_{k}": M.over(m.measures["orders_placed"], P.edge(DAY, kind, k.split("_")[0] if "_" in k else "month")) for k, kind in kinds.items()}
    c = M.Context().calculate("cal_month", F.col("cal_month").isin(2, 3, 5, 11))
    return _numbers(m.query(["cal_year", "cal_quarter"], ["orders_placed", *extra], c, extra), "orders_placed", *extra)


def shipped_periods(spark, d):
    """A period over an inactive relationship, with a filter and a filtered measure: line values to date by their day."""
    m = dated_model(spark, d)
    shipped = replace(m.measures["revenue"], uses="shipped")
    returned = replace(m.measures["returned_lines"], uses="shipped")
    extra = {"shipped": shipped, "shipped_ytd": M.over(shipped, P.to_date(DAY)), "returned_ytd": M.over(returned, P.to_date(DAY)), "placed_ytd": M.over(m.measures["revenue"], P.to_date(DAY))}
    c = M.Context().calculate("p_brand", F.col("p_brand").isin("Brand#1", "Brand#12")).calculate("cal_year", F.col("cal_year") == 1996)
    return _numbers(m.query(["cal_month", "p_brand"], list(extra), c, extra), "returned_ytd")


def month_edges(spark, d):
    """STARTOFMONTH, ENDOFMONTH, STARTOFYEAR, ENDOFYEAR of the dates that each status has, on the dates themselves."""
    from ..operators import time_intelligence as TI

    o = parquet(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus").where(F.col("day").between("1996-02-10", "1997-05-20"))
    out = None
    for unit in ("month", "year"):
        part = TI.edges(o, "day", unit, ("o_orderstatus",)).select("o_orderstatus", F.col("start_of").alias(f"{unit}_start"), F.col("end_of").alias(f"{unit}_end"))
        out = part if out is None else out.join(part, "o_orderstatus")
    return out


def data_until_any_period(spark, d):
    """The last date with data, whatever period the context asks for, beside what the period has."""
    m = dated_model(spark, d)
    extra = {"until": M.largest("orders", "o_day", ignores=frozenset({"cal_year", "cal_month", "cal_day"})), "until_here": M.largest("orders", "o_day")}
    c = M.Context().calculate("cal_year", F.col("cal_year") == 1996)
    return _numbers(m.query(["o_orderstatus"], ["until", "until_here", "orders_placed"], c, extra), "orders_placed")


def treated_as_table(spark, d):
    """TREATAS of tables: pairs of brand and size from parts, and years from orders' own text, as filters of other columns."""
    m = dated_model(spark, d)
    parts = m.tables["part"]
    pairs = parts.where("p_retailprice > 980").select(F.upper("p_brand"), "p_size")
    years = m.tables["orders"].where("o_totalprice > 498500").select(F.year("o_orderdate") - 1)
    c = M.Context().treat_as(("p_brand", "p_size"), pairs).treat_as(("cal_year",), years)
    return m.query(["p_brand", "cal_year"], ["lines", "quantity"], c)


def related_spine(spark, d):
    """A measure that the groups can't narrow: its value for the nations of one region only."""
    m = model(spark, d)
    c = M.Context().calculate("r_name", F.col("r_name") == "ASIA").calculate("p_size", F.col("p_size") > 10)
    return m.query(["n_name"], ["parts", "part_sizes"], c, {"parts": M.count_rows("part"), "part_sizes": M.distinct_count("part", "p_size")})


def scopes(spark, d):
    """ISFILTERED, ISCROSSFILTERED, HASONEFILTER and ISINSCOPE by groups and filters, related tables and both directions."""
    m = model(spark, d)
    m.relationships = [replace(r, both=True) if r.many == "orders" else r for r in m.relationships]
    extra = {
        "nation_filtered": M.Inspection("filtered", "n_name"), "segment_filtered": M.Inspection("filtered", "c_mktsegment"), "region_table_filtered": M.Inspection("filtered", "region"), "name_filtered": M.Inspection("filtered", "c_name"),
        "orders_crossed": M.Inspection("cross", "orders"), "parts_crossed": M.Inspection("cross", "part"), "customers_crossed": M.Inspection("cross", "customer"), "nation_in_scope": M.Inspection("scope", "n_name"), "region_in_scope": M.Inspection("scope", "r_name"),
        "one_segment": M.Inspection("one filter", "c_mktsegment"), "one_status": M.Inspection("one filter", "o_orderstatus"),
    }
    c = M.Context().calculate("c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).calculate("o_orderstatus", F.col("o_orderstatus") == "F")
    return _numbers(m.query(["r_name", "n_name"], [*extra, "orders_placed"], c, extra), "orders_placed")


def share_of_selected(spark, d):
    """ALLSELECTED: the share of each nation of what the context shows, beside its share of all."""
    m = model(spark, d)
    v = m.measures["order_value"]
    extra = {
        "shown": replace(v, selected=frozenset({"n_name"})), "all": replace(v, ignores=frozenset({"n_name", "r_name"})),
        "of_shown": M.Derived(("order_value", "shown"), lambda a, b: F.round(a.cast("double") / b.cast("double"), 8)), "of_all": M.Derived(("order_value", "all"), lambda a, b: F.round(a.cast("double") / b.cast("double"), 8)),
    }
    c = M.Context().calculate("r_name", F.col("r_name").isin("ASIA", "EUROPE"))
    return m.query(["n_name"], ["order_value", "of_shown", "of_all"], c, extra)


def calculated_table(spark, d):
    """CALCULATETABLE and VALUES: the customers that a context shows, and their nations."""
    m = model(spark, d)
    c = M.Context().calculate("r_name", F.col("r_name") == "AFRICA").calculate("c_acctbal", F.col("c_acctbal") > 5000)
    rows = m.calculate_table("customer", c).groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast(MONEY)).cast("double").alias("balance"))
    return rows.join(m.visible(c, "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "balance")


def model_catalog(spark, d):
    """INFO.VIEW tables (with their rows), columns and relationships of the model over the given tables, as one listing."""
    m = model(spark, d)
    v = T.catalog(m)
    rows = None
    for name in m.tables:
        part = m.tables[name].agg(F.count("*").cast("string").alias("detail")).withColumn("of", F.lit(name))
        rows = part if rows is None else rows.union(part)
    t = v["tables"].join(rows, F.col("name") == F.col("of")).select(F.lit("table").alias("kind"), "name", "detail")
    c = v["columns"].select(F.lit("column"), F.concat_ws(".", "table", "name"), F.col("type"))
    r = v["relationships"].where("active").select(F.lit("relationship"), F.concat_ws(".", "many", "many_key"), F.concat_ws(".", "one", "one_key"))
    return t.union(c).union(r)


def joined_names(spark, d):
    """CONCATENATEX: the nations of each region in reverse order of their keys."""
    m = model(spark, d)
    df = m.related("nation", ["r_name"]).withColumn("back", -F.col("n_nationkey"))
    return T.concatenated(df, ["r_name"], "n_name", "; ", "back")


def blank_cardinality(spark, d):
    """How many values columns have, blanks counted apart and as a value."""
    return T.cardinality(parquet(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.lower("l_linestatus").alias("status"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("line")), ["flag", "status", "line"])


def remaining_scalars(spark, d):
    """EXP, PI, ABS, FIXED, TIME, ISERROR and the two-argument MIN and MAX, on order lines."""
    x, y = F.col("l_discount"), F.col("l_tax")
    price = F.col("l_extendedprice")
    return parquet(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.exp(x), 9).alias("exp"), F.round(F.pi() * x, 9).alias("arc"), F.abs(x - y).alias("gap"), S.smaller(x, F.when(y > 0.04, y)).alias("least"), S.larger(x, F.when(y > 0.04, y)).alias("most"),
        S.fixed(price, 1).alias("fixed"), S.is_error(S.value(F.col("l_returnflag")), F.col("l_returnflag")).alias("bad"), S.time(F.col("l_linenumber"), F.lit(75), F.lit(3)).cast("string").alias("clock"),
    )


QUERY_LIST = (
    period_measures, shifted_measures, windowed_measures, edge_measures, shipped_periods, month_edges, data_until_any_period, treated_as_table, related_spine, scopes, share_of_selected, calculated_table, model_catalog,
    joined_names, blank_cardinality, remaining_scalars,
)

_CALENDAR = """c AS (SELECT d::DATE AS cal_day, year(d)::INT AS cal_year, quarter(d)::INT AS cal_quarter, month(d)::INT AS cal_month FROM (
    SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders))"""

_O = "o AS (SELECT *, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,4) AS v FROM orders)"
_MONTH_BOUNDS = "m AS (SELECT cal_year, cal_month, min(cal_day) AS f, max(cal_day) AS l FROM c GROUP BY ALL)"


def _counted(**spans: str) -> str:
    """Counts of orders between two days, as columns."""
    return ", ".join(f"nullif(count(*) FILTER (WHERE day BETWEEN {span}), 0)::DOUBLE AS {k}" for k, span in spans.items())


_EDGES = ", ".join(
    f"(SELECT nullif(count(*), 0)::DOUBLE FROM o WHERE day = {at}) AS at_{k}"
    for k, at in {
        "first": "f", "last": "l", "month_start": "date_trunc('month', f)", "month_end": "last_day(l)", "year_start": "date_trunc('year', f)", "year_end": "make_date(year(l), 12, 31)",
        "quarter_start": "date_trunc('quarter', f)", "quarter_end": "(date_trunc('quarter', l) + INTERVAL 3 MONTH - INTERVAL 1 DAY)",
    }.items()
)

ORACLE_SQL = {
    "period_measures": f"""WITH {_CALENDAR}, {_O}, {_MONTH_BOUNDS},
        x AS (SELECT n_name, day, v FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'building'),
        s AS (SELECT cal_year, cal_month, n_name, (sum(v) FILTER (WHERE day BETWEEN f AND l))::DOUBLE AS order_value, (sum(v) FILTER (WHERE day BETWEEN date_trunc('year', f) AND l))::DOUBLE AS order_value_ytd,
            (sum(v) FILTER (WHERE date_trunc('month', day) = f - INTERVAL 1 YEAR))::DOUBLE AS order_value_last_year, (sum(v) FILTER (WHERE date_trunc('quarter', day) = date_trunc('quarter', f - INTERVAL 3 MONTH)))::DOUBLE AS order_value_last_quarter
            FROM m, x WHERE cal_year BETWEEN 1995 AND 1997 GROUP BY ALL)
        SELECT *, round((order_value - order_value_last_year) / nullif(order_value_last_year, 0), 8) AS growth FROM s WHERE coalesce(order_value, order_value_ytd, order_value_last_year, order_value_last_quarter) IS NOT NULL""",
    "shifted_measures": f"""WITH {_CALENDAR}, {_O}, q AS (SELECT cal_year, cal_quarter, min(cal_day) AS f, max(cal_day) AS l FROM c WHERE cal_year IN (1996, 1997) GROUP BY ALL)
        SELECT cal_year, cal_quarter, {_counted(orders_placed="f AND l", month_before="f - INTERVAL 1 MONTH AND f + INTERVAL 2 MONTH - INTERVAL 1 DAY", week_after="f + 7 AND l + 7",
            year_before="make_date(year(f) - 1, 1, 1) AND make_date(year(f) - 1, 12, 31)", year_after="make_date(year(l) + 1, 1, 1) AND make_date(year(l) + 1, 12, 31)", month_after="l + 1 AND last_day(l + 1)",
            half_before="f - INTERVAL 6 MONTH AND f - INTERVAL 3 MONTH - INTERVAL 1 DAY", qtd="f AND l", mtd="date_trunc('month', l) AND l", day_before="f - 1 AND f - 1")} FROM q, o GROUP BY ALL""",
    "windowed_measures": f"""WITH {_CALENDAR}, {_O}, {_MONTH_BOUNDS}
        SELECT cal_year, cal_month, nullif(count(DISTINCT o_custkey) FILTER (WHERE day BETWEEN f AND l), 0)::DOUBLE AS buyers, (sum(v) FILTER (WHERE day > l - INTERVAL 3 MONTH AND day <= l))::DOUBLE AS value_3m,
            nullif(count(DISTINCT o_custkey) FILTER (WHERE day > l - INTERVAL 3 MONTH AND day <= l), 0)::DOUBLE AS buyers_3m,
            {_counted(orders_90d="l - 89 AND l", spring_1996="DATE '1996-03-01' AND DATE '1996-05-31'", since_1998="DATE '1998-01-01' AND DATE '9999-01-01'", from_may="DATE '1995-05-01' AND DATE '1995-06-30'")}
        FROM m, o GROUP BY ALL""",
    "edge_measures": f"""WITH {_CALENDAR}, {_O}, q AS (SELECT cal_year, cal_quarter, min(cal_day) AS f, max(cal_day) AS l FROM c WHERE cal_month IN (2, 3, 5, 11) GROUP BY ALL),
        s AS (SELECT cal_year, cal_quarter, (SELECT nullif(count(*), 0)::DOUBLE FROM o WHERE year(day) = cal_year AND quarter(day) = cal_quarter AND month(day) IN (2, 3, 5, 11)) AS orders_placed, {_EDGES} FROM q)
        SELECT * FROM s WHERE coalesce(orders_placed, at_first, at_last, at_month_start, at_month_end, at_year_start, at_year_end, at_quarter_start, at_quarter_end) IS NOT NULL""",
    "shipped_periods": f"""WITH {_CALENDAR}, x AS (SELECT p_brand, l_shipdate::DATE AS shipped_day, o_orderdate::DATE AS placed_day, l_extendedprice::DECIMAL(18,4) AS v, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey WHERE p_brand IN ('Brand#1', 'Brand#12')),
        m AS (SELECT cal_month, min(cal_day) AS f, max(cal_day) AS l FROM c WHERE cal_year = 1996 GROUP BY ALL),
        s AS (SELECT cal_month, p_brand, (sum(v) FILTER (WHERE shipped_day BETWEEN f AND l))::DOUBLE AS shipped, (sum(v) FILTER (WHERE shipped_day BETWEEN DATE '1996-01-01' AND l))::DOUBLE AS shipped_ytd,
            nullif(count(*) FILTER (WHERE l_returnflag = 'R' AND shipped_day BETWEEN DATE '1996-01-01' AND l), 0)::DOUBLE AS returned_ytd, (sum(v) FILTER (WHERE placed_day BETWEEN DATE '1996-01-01' AND l))::DOUBLE AS placed_ytd FROM m, x GROUP BY ALL)
        SELECT * FROM s WHERE coalesce(shipped, shipped_ytd, returned_ytd, placed_ytd) IS NOT NULL""",
    "month_edges": """WITH o AS (SELECT o_orderdate::DATE AS day, o_orderstatus FROM orders WHERE o_orderdate >= '1996-02-10' AND o_orderdate < '1997-05-21'), s AS (SELECT o_orderstatus, min(day) AS a, max(day) AS b FROM o GROUP BY ALL)
        SELECT o_orderstatus, (SELECT min(day) FROM o WHERE date_trunc('month', day) = date_trunc('month', a))::VARCHAR AS month_start, (SELECT max(day) FROM o WHERE date_trunc('month', day) = date_trunc('month', b))::VARCHAR AS month_end,
            (SELECT min(day) FROM o WHERE year(day) = year(a))::VARCHAR AS year_start, (SELECT max(day) FROM o WHERE year(day) = year(b))::VARCHAR AS year_end FROM s""",
    "data_until_any_period": """SELECT o_orderstatus, max(o_orderdate)::DATE::VARCHAR AS until, (max(o_orderdate) FILTER (WHERE year(o_orderdate) = 1996))::DATE::VARCHAR AS until_here, nullif(count(*) FILTER (WHERE year(o_orderdate) = 1996), 0)::DOUBLE AS orders_placed
        FROM orders GROUP BY ALL HAVING count(*) FILTER (WHERE year(o_orderdate) = 1996) > 0""",
    "treated_as_table": """SELECT p_brand, year(o_orderdate)::INT AS cal_year, count(*) AS lines, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE (lower(p_brand), p_size) IN (SELECT lower(p_brand), p_size FROM part WHERE p_retailprice > 980) AND year(o_orderdate) IN (SELECT year(o_orderdate) - 1 FROM orders WHERE o_totalprice > 498500) GROUP BY ALL""",
    "related_spine": "SELECT n_name, parts, part_sizes FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT count(*) AS parts, count(DISTINCT p_size) AS part_sizes FROM part WHERE p_size > 10) WHERE r_name = 'ASIA'",
    "scopes": """WITH k AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')),
        o AS (SELECT r_name, n_name, count(*) AS orders_placed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F' GROUP BY ALL),
        s AS (SELECT r_name, n_name, count(DISTINCT c_mktsegment) = 1 AS one FROM k GROUP BY ALL)
        SELECT r.r_name, n.n_name, true AS nation_filtered, true AS segment_filtered, true AS region_table_filtered, false AS name_filtered, true AS orders_crossed, false AS parts_crossed, true AS customers_crossed, n.n_regionkey = r.r_regionkey AS nation_in_scope, true AS region_in_scope,
            coalesce(s.one, false) AS one_segment, o.orders_placed IS NOT NULL AS one_status, o.orders_placed::DOUBLE AS orders_placed FROM region r CROSS JOIN nation n LEFT JOIN s ON s.r_name = r.r_name AND s.n_name = n.n_name LEFT JOIN o ON o.r_name = r.r_name AND o.n_name = n.n_name""",
    "share_of_selected": """WITH s AS (SELECT r_name, n_name, sum(o_totalprice::DECIMAL(18,4)) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
        SELECT n_name, v::DOUBLE AS order_value, round(v::DOUBLE / (SELECT sum(v) FROM s WHERE r_name IN ('ASIA', 'EUROPE'))::DOUBLE, 8) AS of_shown, round(v::DOUBLE / (SELECT sum(o_totalprice::DECIMAL(18,4)) FROM orders)::DOUBLE, 8) AS of_all FROM s WHERE r_name IN ('ASIA', 'EUROPE')
        UNION ALL SELECT n_name, NULL, NULL, NULL FROM nation WHERE false""",
    "calculated_table": "SELECT n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA' AND c_acctbal > 5000 GROUP BY ALL",
    "model_catalog": """WITH names AS (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events']) AS t),
        sizes AS (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part
            UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events)
        SELECT 'table' AS kind, t AS name, n::VARCHAR AS detail FROM sizes
        UNION ALL SELECT 'column', table_name || '.' || column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END FROM information_schema.columns WHERE table_name IN (SELECT t FROM names)
        UNION ALL SELECT 'relationship', unnest(['lineitem.l_orderkey', 'orders.o_custkey', 'lineitem.l_partkey', 'lineitem.l_suppkey', 'customer.c_nationkey', 'nation.n_regionkey']), unnest(['orders.o_orderkey', 'customer.c_custkey', 'part.p_partkey', 'supplier.s_suppkey', 'nation.n_nationkey', 'region.r_regionkey'])""",
    "joined_names": "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_nationkey DESC) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "blank_cardinality": "SELECT count(DISTINCT nullif(l_returnflag, 'N')) + 1 AS flag, count(DISTINCT lower(l_linestatus)) AS status, count(DISTINCT CASE WHEN l_linenumber < 6 THEN l_linenumber END) + max((l_linenumber >= 6)::INT) AS line FROM lineitem",
    "remaining_scalars": """SELECT l_orderkey, l_linenumber, round(exp(l_discount), 9) AS exp, round(pi() * l_discount, 9) AS arc, abs(l_discount - l_tax) AS gap, CASE WHEN l_tax > 0.04 THEN least(l_discount, l_tax) ELSE l_discount END AS least, CASE WHEN l_tax > 0.04 THEN greatest(l_discount, l_tax) ELSE l_discount END AS most,
        translate(format('{:,.1f}', l_extendedprice), ',.', '.,') AS fixed, true AS bad, (TIMESTAMP '1899-12-30' + to_hours(l_linenumber::INT) + to_minutes(75) + to_seconds(3))::VARCHAR AS clock FROM lineitem""",
}
