"""Queries of reports: filters with negation and blanks, months of all years, ranked and detailed lists, shares, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import tables as T
from ..plans import reports as RP
from ..sources.files import parquet
from ..star import MONEY, dated_model, model


def negated_filters(spark, d):
    """Parts of some kinds and without some brands; negations keep blanks unless they exclude them."""
    part = parquet(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")))
    some = part.where(RP.categorical("p_type", ["standard", "PROMO"]) & RP.categorical("p_brand", ["brand#1", "BRAND#3"], negate=True) & RP.categorical("p_size", [3, 0], text=False, negate=True))
    none = part.where(RP.categorical("p_brand", ["brand#1", None], negate=True))
    return some.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).union(none.groupBy(F.lit("all"), "p_brand").agg(F.count("*")))


def months_of_all_years(spark, d):
    """Orders of January and March of any year, of March 1997, of 1998 and of a range, by status."""
    o = parquet(spark, d, "orders")
    kinds = {"any_year": RP.dated("o_orderdate", months=[3, 1]), "one_month": RP.dated("o_orderdate", year=1997, months=[3]), "one_year": RP.dated("o_orderdate", year=1998), "two_months": RP.dated("o_orderdate", year=1999, months=[11, 12]), "span": RP.dated("o_orderdate", "1996-02-10", "1996-04-01")}
    return o.groupBy("o_orderstatus").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))


def ranked_report(spark, d):
    """The three brands with most lines where a brand is known, and all of them with the unknown one."""
    m = model(spark, d)
    t = m.tables
    part = parquet(spark, d, "part").withColumn("p_brand", F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")))
    m = M.Model(M.Tables(list(t), lambda n: part if n == "part" else t[n], t.owners), m.relationships, m.measures)
    some, every = RP.ranked(m, ["p_brand"], "quantity", 3, largest=False), RP.ranked(m, ["p_brand"], "quantity")
    return some.select(F.lit("three").alias("kind"), "p_brand", F.col("quantity").cast("double").alias("quantity")).union(every.select(F.lit("all"), "p_brand", F.col("quantity").cast("double")))


def detail_listing(spark, d):
    """The first forty distinct pairs of segment and nation with orders of a status and value, and whether there are more."""
    c = M.Context().calculate("o_orderstatus", F.col("o_orderstatus") == "F").calculate("o_totalprice", F.col("o_totalprice") > 200000)
    return RP.detail(model(spark, d), "orders", ["c_mktsegment", "n_name"], 40, c)


def last_data(spark, d):
    """The last day with orders of a status and region, whatever year the context asks for."""
    c = M.Context().calculate("cal_year", F.col("cal_year") == 1996).calculate("r_name", F.col("r_name") == "ASIA").calculate("o_orderstatus", F.col("o_orderstatus") == "P")
    return RP.data_until(dated_model(spark, d), "cal_day", "orders_placed", c, ["cal_year"]).select(F.col("until").cast("string").alias("until"))


def shares_of_filters(spark, d):
    """Each segment's share of orders in two regions, of its own orders in all regions."""
    c = M.Context().calculate("r_name", F.col("r_name").isin("ASIA", "AFRICA")).calculate("o_orderstatus", F.col("o_orderstatus") != "P")
    df = RP.shares(model(spark, d), ["c_mktsegment"], "orders_placed", c, ["r_name"])
    return df.select("c_mktsegment", F.col("value").cast("double").alias("value"), F.round("share", 8).alias("share"), RP.percent(F.round("share", 6)).alias("text"))


def composed_tables(spark, d):
    """Three measures by nation, each over other rows, merged in first-seen order with the filters they share."""
    m = model(spark, d)
    both = M.Context().calculate("c_mktsegment", F.col("c_mktsegment") == "BUILDING")
    contexts = [both.calculate("o_orderstatus", F.col("o_orderstatus") == "P"), both.calculate("o_totalprice", F.col("o_totalprice") > 480000), both]
    common, own = RP.common_filters(contexts)
    frames = []
    for i, (x, measure) in enumerate(zip(own, ("orders_placed", "order_value", "buyers"), strict=True)):
        df = m.query(["n_name"], [measure], M.Context((*common.filters, *x.filters)))
        df = df.select("n_name", F.col(measure).cast("double").alias(f"v{i}"))
        frames.append(T.ranked(df.withColumn("__k", F.regexp_extract("n_name", r"(\d+)$", 1).cast("int")), F.col("__k"), "place", up=True).drop("__k"))
    return RP.composed(frames, ["n_name"])


def large_values(spark, d):
    """Balances of nations as they are shown: sums with separators, shares by the fraction rule."""
    c = parquet(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast(MONEY)).alias("v"), F.count("*").alias("n"))
    return c.select("c_nationkey", RP.percent(F.round(F.col("n") / 1000, 4)).alias("share"), RP.percent(F.col("n").cast("double") + 1.5).alias("points"))


QUERY_LIST = (negated_filters, months_of_all_years, ranked_report, detail_listing, last_data, shares_of_filters, composed_tables, large_values)

_ALL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PERCENT = "translate(format('{{:,.1f}}', {0}), ',.', '.,') || ' %'"
ORACLE_SQL = {
    "negated_filters": """WITH p AS (SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS b FROM part)
        SELECT p_type, b AS p_brand, count(*) AS n FROM p WHERE lower(p_type) IN ('standard', 'promo') AND (b IS NULL OR lower(b) NOT IN ('brand#1', 'brand#3')) AND p_size NOT IN (3, 0) GROUP BY ALL UNION ALL SELECT 'all', b, count(*) FROM p WHERE lower(b) <> 'brand#1' GROUP BY ALL""",
    "months_of_all_years": """SELECT o_orderstatus, count(*) FILTER (WHERE month(o_orderdate) IN (1, 3)) AS any_year, count(*) FILTER (WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 3) AS one_month, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS one_year,
        count(*) FILTER (WHERE year(o_orderdate) = 1999 AND month(o_orderdate) > 10) AS two_months, count(*) FILTER (WHERE o_orderdate >= '1996-02-10' AND o_orderdate < '1996-04-01') AS span FROM orders GROUP BY ALL""",
    "ranked_report": """WITH q AS (SELECT CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS p_brand, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT 'three' AS kind, p_brand, quantity FROM (SELECT *, rank() OVER (ORDER BY quantity) AS r FROM q WHERE p_brand IS NOT NULL) WHERE r <= 3 UNION ALL SELECT 'all', * FROM q""",
    "detail_listing": f"""WITH g AS (SELECT c_mktsegment, n_name, count(*) AS n FROM {_ALL} WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY ALL)
        SELECT *, (SELECT count(*) FROM g) > 40 AS is_cut FROM (FROM g ORDER BY c_mktsegment NULLS FIRST, n_name NULLS FIRST LIMIT 40)""",
    "last_data": f"SELECT max(o_orderdate)::DATE::VARCHAR AS until FROM {_ALL} WHERE r_name = 'ASIA' AND o_orderstatus = 'P'",
    "shares_of_filters": f"""WITH s AS (SELECT c_mktsegment, (count(*) FILTER (WHERE r_name IN ('ASIA', 'AFRICA')))::DOUBLE AS value, count(*)::DOUBLE AS whole FROM {_ALL} WHERE o_orderstatus <> 'P' GROUP BY ALL)
        SELECT c_mktsegment, value, round(value / whole, 8) AS share, {_PERCENT.format("round(value / whole, 6) * 100")} AS text FROM s WHERE value > 0""",
    "composed_tables": f"""WITH o AS (SELECT * FROM {_ALL} WHERE c_mktsegment = 'BUILDING'), k AS (SELECT *, regexp_extract(n_name, '([0-9]+)$', 1)::INT AS k FROM o),
        a AS (SELECT n_name, count(*)::DOUBLE AS v0, rank() OVER (ORDER BY k) AS p FROM k WHERE o_orderstatus = 'P' GROUP BY n_name, k), b AS (SELECT n_name, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS v1, rank() OVER (ORDER BY k) AS p FROM k WHERE o_totalprice > 480000 GROUP BY n_name, k),
        c AS (SELECT n_name, count(DISTINCT o_custkey)::DOUBLE AS v2, rank() OVER (ORDER BY k) AS p FROM k GROUP BY n_name, k)
        SELECT c.n_name, v0, v1, v2, CASE WHEN a.p IS NOT NULL THEN 0 WHEN b.p IS NOT NULL THEN 1 ELSE 2 END AS first_table, coalesce(a.p, b.p, c.p)::DOUBLE AS first_row FROM c LEFT JOIN a USING (n_name) LEFT JOIN b USING (n_name)""",
    "large_values": f"SELECT c_nationkey, {_PERCENT.format('CASE WHEN round(count(*) / 1000, 4) <= 1 THEN round(count(*) / 1000, 4) * 100 ELSE round(count(*) / 1000, 4) END')} AS share, {_PERCENT.format('count(*) + 1.5::DOUBLE')} AS points FROM customer GROUP BY ALL",
}
