"""Registered queries of the semantic layer over the test tables, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import matching as MT
from .functions import scalars as S
from .operators import model as M
from .operators import tables as T
from .operators import time_intelligence as TI
from .plans import retrieval as R
from .registry import catalogue, contexts, documents, language, reports, retrieval, streams
from .sources.files import parquet
from .star import MONEY, model, plain_types
from .streaming import events as E

def scalar_measures(spark, d):
    return model(spark, d).query([], ["revenue", "net_revenue", "quantity", "lines", "returned_lines", "orders_placed", "order_value", "buyers"])


def grouped_measures(spark, d):
    return model(spark, d).query(["r_name", "p_brand"], ["revenue", "lines"])


def filtered_context(spark, d):
    c = M.Context().calculate("c_mktsegment", F.lower("c_mktsegment").isin("building", "machinery")).calculate("l_shipdate", F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return model(spark, d).query(["n_name"], ["net_revenue", "returned_lines"], c)


def replaced_filter(spark, d):
    c = M.Context().calculate("o_orderstatus", F.col("o_orderstatus") == "F").calculate("o_orderstatus", F.col("o_orderstatus") == "P")
    return model(spark, d).query(["o_orderpriority"], ["orders_placed", "order_value"], c)


def two_facts(spark, d):
    return model(spark, d).query(["c_mktsegment"], ["revenue", "orders_placed", "buyers"])


def both_directions(spark, d):
    """Filters on order lines and their parts narrow orders and customers: the same line has to meet both."""
    m = model(spark, d)
    m.relationships[:2] = [replace(r, both=True) for r in m.relationships[:2]]
    c = M.Context().calculate("l_returnflag", F.col("l_returnflag") == "R").calculate("p_brand", F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#13"))
    extra = {"customers": M.count_rows("customer")}
    return m.query(["c_mktsegment"], ["customers", "orders_placed", "order_value", "lines"], c, extra)


def removed_filter(spark, d):
    c = M.Context().calculate("l_returnflag", F.col("l_returnflag") == "R")
    return model(spark, d).query(["p_brand"], ["revenue", "all_revenue"], c)


def data_until(spark, d):
    return model(spark, d).query(["l_returnflag"], ["first_shipment", "last_shipment"])


def role_playing(spark, d):
    q = F.col("l_quantity").cast(MONEY)
    extra = {"bought": M.total("lineitem", q, uses="buyer nation"), "sold": M.total("lineitem", q, uses="supplier nation")}
    return model(spark, d).query(["n_name"], ["bought", "sold"], extra=extra)


def both_roles(spark, d):
    return model(spark, d).query(["buyer=n_name@buyer nation", "seller=n_name@supplier nation"], ["quantity", "lines"])


def measure_filter_replaces(spark, d):
    c = M.Context().calculate("l_returnflag", F.col("l_returnflag") == "A")
    return model(spark, d).query(["p_brand"], ["lines", "returned_lines"], c)


def measure_filter_over_groups(spark, d):
    return model(spark, d).query(["l_returnflag"], ["lines", "returned_lines", "share_returned"])


def kept_filter(spark, d):
    kept = {"kept": M.count_rows("lineitem", keep={"l_returnflag": F.col("l_returnflag").isin("R", "A")})}
    c = M.Context().calculate("l_returnflag", F.col("l_returnflag").isin("A", "N"))
    return model(spark, d).query(["l_returnflag"], ["lines", "kept"], c, kept).fillna(0, ["kept"])


def measure_order(spark, d):
    return model(spark, d).query(["l_returnflag"], ["all_revenue", "revenue"])


def unrelated_dimension(spark, d):
    return model(spark, d).query(["p_brand"], ["orders_placed", "revenue"])


def measure_of_measures(spark, d):
    return model(spark, d).query(["r_name"], ["revenue_a_line", "share_returned"])


def all_except(spark, d):
    m = model(spark, d)
    extra = {"of_segment": M.count_rows("orders", ignores=m.all_except("orders", "c_mktsegment"))}
    return m.query(["c_mktsegment", "o_orderstatus"], ["orders_placed", "of_segment"], extra=extra)


def year_month_pairs(spark, d):
    m = model(spark, d)
    orders = parquet(spark, d, "orders").withColumns({"o_year": F.year("o_orderdate"), "o_month": F.month("o_orderdate")})
    m.tables = {**m.tables, "orders": orders}
    c = M.Context().treat_as(("o_year", "o_month"), TI.year_months("1995-11-01", "1996-02-29")).treat_as(("c_mktsegment",), [("building",), ("Furniture",)])
    return m.query(["o_year", "o_month", "c_mktsegment"], ["orders_placed", "order_value"], c)


def iterated(spark, d):
    return model(spark, d).iterated(["r_name"], ["n_name"], "orders_placed", {"mean": F.avg, "middle": F.median, "low": F.min, "high": F.max, "nations": F.count})


def counts(spark, d):
    flag = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority"))
    extra = {"known": M.count("orders", flag), "blank": M.count_blank("orders", flag), "kinds": M.distinct_count("orders", flag), "kinds_known": M.distinct_count("orders", flag, False), "none": M.is_empty("orders"), "mean": M.average("orders", "o_totalprice"), "middle": M.median("orders", "o_totalprice")}
    df = model(spark, d).query(["c_mktsegment"], list(extra), extra=extra)
    return df.withColumns({"mean": F.round("mean", 6), "middle": F.round("middle", 6)})


def inspected(spark, d):
    c = M.Context().calculate("n_name", F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3", "NATION_4"))
    m = model(spark, d)
    extra = {"one": M.has_one_value("orders", "n_name"), "nation": M.selected_value("orders", "n_name", "several")}
    df = m.query(["r_name"], ["one", "nation"], c, extra)
    return df.withColumns({"filtered": F.lit(c.is_filtered("n_name")), "crossed": F.lit(m.cross_filtered(c, "orders")), "part_crossed": F.lit(m.cross_filtered(c, "part"))})


def edge_values(spark, d):
    m = model(spark, d)
    a = m.edge_nonblank(["c_mktsegment"], "o_orderdate", "open_orders", "first_open", False)
    return a.join(m.edge_nonblank(["c_mktsegment"], "o_orderdate", "open_orders", "last_open"), "c_mktsegment")


def summarized(spark, d):
    return T.summarize(model(spark, d), "orders", ["r_name", "o_orderstatus"], n=F.count("*"), least=F.min("o_totalprice"))


def related_rows(spark, d):
    return T.related_table(parquet(spark, d, "customer").select("c_custkey"), parquet(spark, d, "orders"), "c_custkey", "o_custkey", n=F.count("*"), most=F.max("o_totalprice"))


def generated(spark, d):
    n = parquet(spark, d, "nation")
    return T.generate(parquet(spark, d, "region"), lambda: n.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).select(F.col("n_name"))).select("r_name", "n_name")


def combined_tables(spark, d):
    seg, flags = T.values(parquet(spark, d, "customer"), "c_mktsegment"), T.values(parquet(spark, d, "orders"), "o_orderstatus")
    pairs = T.cross_join(seg, flags)
    more = T.select_columns(parquet(spark, d, "region"), segment=F.col("r_name"), status=F.lit("-"))
    return T.add_columns(T.union_rows(pairs, more), label=F.concat_ws(" / ", "c_mktsegment", "o_orderstatus"))


def distinct_tuples(spark, d):
    return T.distinct_rows(parquet(spark, d, "part").select("p_brand", "p_type"))


def up_and_down(spark, d):
    df = model(spark, d).query(["p_brand"], ["lines"])
    return T.ranked(T.top_n(df, 7, (F.col("lines"), True)), F.col("lines"), "place", dense=True, up=True)


def looked_up_pair(spark, d):
    parts = parquet(spark, d, "part")
    asked = parts.select("p_brand", "p_size").distinct()
    return T.lookup(asked, parts.select(F.lower("p_brand").alias("b"), F.col("p_size").alias("z"), "p_type"), {"p_brand": "b", "p_size": "z"}, "p_type", "several")


def domain_values(spark, d):
    return T.domains(parquet(spark, d, "customer"), ["c_mktsegment", "c_nationkey", "c_name"], 50)


def logic_scalars(spark, d):
    x, s = F.col("l_quantity"), F.col("l_returnflag")
    some = F.when(s == "N", None).otherwise(x)
    return parquet(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.choose(some > 25, F.lit("high"), F.lit("low")).alias("size"), S.switch(s, (F.lit("r"), F.lit(1)), (F.lit("a"), F.lit(2)), otherwise=F.lit(0), text=True).alias("code"),
        S.both(some > 10, some < 40).alias("mid"), S.either(some > 45, F.lit(None).cast("boolean")).alias("top"), S.negated(some > 10).alias("not_big"), S.is_blank(some).alias("blank"), S.is_number(some).alias("number"),
        S.is_text(s).alias("text"), S.is_nontext(x).alias("nontext"), S.is_logical(x > 1).alias("logical"), S.first_known(some, F.lit(-1.0)).alias("known"), S.plus(some, F.lit(None).cast("double")).alias("plus"),
        S.if_error(S.value(F.concat(s, x.cast("string"))), s, F.lit(-2.0)).alias("tried"), S.equal(some, F.lit(0.0), 0.0).alias("is_zero"),
    )


def number_scalars(spark, d):
    x = F.col("l_extendedprice")
    return parquet(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.rounded(x / 7, 2).alias("two"), S.rounded(x, -2).alias("hundreds"), S.integer(-x / 3).alias("whole"), S.round_down(-x / 3, 1).alias("down"), S.quotient(x, F.lit(1000.0)).alias("quotient"),
        F.round(S.power(F.col("l_discount"), F.lit(2)), 9).alias("square"), F.round(S.root(x), 6).alias("root"), F.round(S.logarithm(x, 10), 9).alias("log10"), F.round(S.logarithm(x), 9).alias("ln"), S.floor(x, 250).cast("double").alias("floor"),
        S.converted(x, "INT64").alias("whole_number"), S.converted(F.col("l_linenumber"), "STRING").alias("text"), S.value(F.lit("12,5")).alias("value"), S.currency(x).cast("double").alias("currency"),
    )


def more_text(spark, d):
    x = F.col("p_name")
    return parquet(spark, d, "part").select(
        "p_partkey", S.left(x, 3).alias("head"), S.right(x, 2).alias("tail"), S.middle(x, 2, 3).alias("inner"), S.length(x).alias("length"), S.substituted(x, "a", "-").alias("put"), S.repeated(F.lit("ab"), 2).alias("twice"),
        S.exact(x, F.upper(x)).alias("same"), S.unicode_character(F.col("p_size") + 65).alias("letter"), S.replaced(x, 2, 2, "__").alias("cut"), S.combined("|", x, F.lit(None).cast("string"), F.col("p_size")).alias("row"),
        S.found("a", x, True, 0, 3).alias("later"), S.contains(x, "A", True).alias("has_upper"),
    )


def more_dates(spark, d):
    t, x = F.col("ts"), F.col("ts").cast("date")
    return parquet(spark, d, "events").select(
        "event_id", F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).cast("int").alias("second"), S.week_number(x).cast("int").alias("week"),
        S.months_later(x, 13).alias("later"), S.date(F.year(x), F.month(x) + 14, F.lit(0)).alias("rolled"), S.date_difference(t, F.lit("2024-03-01").cast("timestamp_ntz"), "HOUR").alias("hours"), S.date_difference(t, F.lit("2024-03-01").cast("timestamp_ntz"), "MINUTE").alias("minutes"),
        S.date_value(F.date_format(x, "dd/MM/yyyy")).alias("read"), S.date_difference(S.today("2024-06-30"), x, "DAY").alias("since"),
    )


def formats(spark, d):
    x, day = F.col("o_totalprice"), F.col("o_orderdate")
    return parquet(spark, d, "orders").select("o_orderkey", S.formatted(x, "#,##0.00").alias("grouped"), S.formatted(x, "0.0").alias("plain"), S.formatted(x / 1e6, "0.00%").alias("percent"), S.formatted_date(day, "dd/MM/yyyy").alias("short"), S.formatted_date(day, "d MMMM yy").alias("long"), S.formatted_date(day, "q-yyyy").alias("quarter"))


def _days(spark, d):
    return TI.by_day(parquet(spark, d, "orders"), "o_orderdate", "o_totalprice", "value", "double")


def day_shifts(spark, d):
    df = TI.shifted(_days(spark, d), "day", "value", "week_before", -7, "day")
    df = TI.whole_period(df, "day", "value", "previous_quarter", -1, "quarter")
    df = TI.whole_period(df, "day", "value", "next_year", 1, "year")
    df = TI.whole_period(df, "day", "value", "previous_day", -1, "day")
    return df.select("day", "value", "week_before", F.round("previous_quarter", 4).alias("previous_quarter"), F.round("next_year", 4).alias("next_year"), "previous_day")


def period_edges(spark, d):
    o = parquet(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    return TI.edges(o.where(F.col("day").between("1995-02-10", "1996-05-20")), "day", "quarter", ("o_orderstatus",))


def month_to_date(spark, d):
    df = TI.to_date(_days(spark, d), "day", "value", "mtd", "month")
    return TI.to_date(df, "day", "value", "qtd", "quarter").select("day", F.round("mtd", 4).alias("mtd"), F.round("qtd", 4).alias("qtd"))


def last_days(spark, d):
    return TI.in_period(_days(spark, d), "day", "value", "ten_days", 10, "day").select("day", F.round("ten_days", 4).alias("ten_days"))


def quarter_buckets(spark, d):
    o = parquet(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast(MONEY))
    return TI.buckets(o, "o_orderdate", "v", "value", "1991-05-15", "1993-08-20", "quarter")


def _valued_orders(spark, d):
    return parquet(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast(MONEY))


def last_quarters(spark, d):
    o = _valued_orders(spark, d).where(TI.in_span("o_orderdate", TI.last_units("1997-08-15", 3, "quarter")))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("value"))


def default_semesters(spark, d):
    o = _valued_orders(spark, d).where(TI.in_span("o_orderdate", TI.default_units("1997-08-15", "semester")))
    return o.groupBy(TI.start_of(F.col("o_orderdate"), "semester").cast("string").alias("semester")).agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("value"))


def periods_compared(spark, d):
    spans = {"last_years": TI.last_units("1997-08-15", 2, "year"), "since_may": TI.since("1997-05-01", "1997-08-15")}
    out = TI.compared(_valued_orders(spark, d), "o_orderdate", "v", ["o_orderpriority"], spans)
    return out.select("o_orderpriority", *(F.col(k).cast("double").alias(k) for k in spans))


def covered_periods(spark, d):
    o = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first"), F.date_add(F.max("o_orderdate").cast("date"), 1).alias("end"))
    year, day = TI.last_units("1994-03-10", 1, "year"), TI.last_units("1994-03-10", 1, "day")
    return o.select("o_custkey", *(TI.covers(F.col("first"), F.col("end"), s, "1994-03-10").alias(k) for k, s in (("has_year", year), ("has_day", day))))


def hard_ranked(spark, d):
    o = _valued_orders(spark, d).groupBy("o_custkey").agg(F.sum("v").cast("double").alias("value"))
    return T.first_rows(o, 7, "value", ["o_custkey"])


def blank_group_share(spark, d):
    li = parquet(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_quantity").cast(MONEY).alias("q"))
    return T.blank_share(li, "flag", "q", 0.1).select(F.col("blank").cast("double").alias("blank"), F.col("total").cast("double").alias("total"), F.round("share", 9).alias("share"))


def listed_values(spark, d):
    return T.listed(parquet(spark, d, "part"), "p_brand", 10)


def nearest_vectors(spark, d):
    e = parquet(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    return R.nearest(e, q, "vec_id", "embedding", "query", "asked", 5).select("query", "vec_id", "place")


def text_chunks(spark, d):
    return R.chunks(parquet(spark, d, "documents"), "doc_id").select("doc_id", "chunk", F.length("text").alias("n_chars"), "chunk_id")


def name_similarity(spark, d):
    p = parquet(spark, d, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return p.select("p_partkey", MT.edit_distance(a, b, 9).alias("distance"), F.round(MT.token_similarity(a, b), 6).alias("similarity"), MT.phonetic(b).alias("sound"), F.round(MT.jaccard(F.col("p_name"), F.concat(a, F.lit(" x"))), 6).alias("jaccard"))


def request_limits(spark, d):
    return E.limited(parquet(spark, d, "events"), 2, 3600).select("event_id", "user_id", "n", F.round("wait", 6).alias("wait"))


def top_with_ties(spark, d):
    return T.top_n(model(spark, d).query(["p_brand"], ["lines"]), 5, F.col("lines"))


def ranked_groups(spark, d):
    return T.ranked(model(spark, d).query(["r_name", "n_name"], ["orders_placed"]), F.col("orders_placed"), within=("r_name",))


def share_of_total(spark, d):
    df = model(spark, d).query(["c_mktsegment"], ["orders_placed"])
    return T.share(df.withColumn("orders_placed", F.col("orders_placed").cast("double")), "orders_placed", "share").select("c_mktsegment", F.round("share", 8).alias("share"))


def running_year(spark, d):
    m = TI.by_month(parquet(spark, d, "orders"), "o_orderdate", "o_totalprice", "value")
    return TI.to_date(m, "month", "value", "ytd").select("month", F.col("value").cast("double").alias("value"), F.col("ytd").cast("double").alias("ytd"))


def last_year(spark, d):
    m = TI.by_month(parquet(spark, d, "orders"), "o_orderdate", "o_totalprice", "value", "double")
    out = TI.shifted(m, "month", "value", "year_before", -12)
    return out.select("month", "value", "year_before", F.round(S.divide(F.col("value") - F.col("year_before"), F.col("year_before")), 8).alias("change"))


def rolling_quarter(spark, d):
    m = TI.by_month(parquet(spark, d, "orders"), "o_orderdate", "o_totalprice", "value")
    return TI.in_period(m, "month", "value", "three_months", 3).select("month", F.col("three_months").cast("double").alias("three_months"))


def period_buckets(spark, d):
    o = TI.between(parquet(spark, d, "orders"), "o_orderdate", "1995-01-01", "1996-12-31")
    g = o.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("orders_placed"))
    return g.withColumn("label", S.concatenated(F.lit("Trim. "), F.col("quarter"), F.lit(" "), F.col("year")))


def calendar(spark, d):
    return T.calendar(parquet(spark, d, "orders"), "o_orderdate").groupBy("year", "quarter").agg(F.count("*").alias("days"))


def except_and_intersect(spark, d):
    c, s = parquet(spark, d, "customer").select("c_nationkey"), parquet(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    a, b = T.except_rows(c, s).agg(F.count("*").alias("n")), T.intersect_rows(c, s).agg(F.count("*").alias("n"))
    return a.select(F.lit("except").alias("kind"), "n").union(b.select(F.lit("intersect"), "n"))


def distinct_values(spark, d):
    return T.values(parquet(spark, d, "events"), "event_type")


def domain_cardinality(spark, d):
    c = parquet(spark, d, "customer")
    return c.agg(*(F.countDistinct(F.lower(F.col(x).cast("string"))).alias(x) for x in ("c_mktsegment", "c_nationkey", "c_name")))


def looked_up(spark, d):
    return T.lookup(parquet(spark, d, "supplier").select("s_suppkey", "s_nationkey"), parquet(spark, d, "nation"), {"s_nationkey": "n_nationkey"}, "n_name")


def text_scalars(spark, d):
    x, p = F.col("p_name"), parquet(spark, d, "part")
    return p.select("p_partkey", F.upper(x).alias("up"), S.found("e", x, alternative=-1).alias("at"), S.contains(x, "A").alias("has"), S.trimmed(F.concat(x, F.lit("  z "))).alias("tidy"), S.plain(F.concat(x, F.lit("Ñandú"))).alias("key"), S.concatenated(F.lit(None).cast("string"), x, F.lit("-"), F.col("p_size")).alias("joined"))


def math_scalars(spark, d):
    a, b = F.col("l_quantity"), F.col("l_linenumber")
    li = parquet(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.modulo(-a, b.cast("double")).alias("modulo"), S.truncated(a / 7).alias("truncated"), S.round_up(a / 7).alias("up"), F.round(S.divide(a, b - 1), 8).alias("divided"), S.ceiling(a, 5).cast("double").alias("ceiling"), S.sign(a - 25).alias("sign"))


def date_scalars(spark, d):
    x = F.col("o_orderdate").cast("date")
    o = parquet(spark, d, "orders")
    return o.select("o_orderkey", S.month_name(x).alias("month"), S.day_name(x).alias("day"), S.weekday(x, 2).alias("weekday"), S.end_of_month(x, 1).alias("next_end"), S.date_difference(x, F.lit("1999-01-01").cast("date"), "MONTH").alias("months"), S.date_difference(x, F.lit("1999-01-01").cast("date"), "QUARTER").alias("quarters"))


def detail(spark, d):
    m = model(spark, d)
    return m.related("orders", ["n_name"]).where("o_totalprice > 400000").select("o_orderkey", "n_name", "o_totalprice")


def event_counts(spark, d):
    return E.counted(parquet(spark, d, "events"))


def over_limit(spark, d):
    return E.over_limit(parquet(spark, d, "events"), 1, "1 day", "12 hours").select(F.col("w.start").alias("start"), "user_id", "n")


QUERIES = {f.__name__: plain_types(f) for f in (
    scalar_measures, grouped_measures, filtered_context, replaced_filter, two_facts, both_directions, removed_filter, data_until, role_playing, top_with_ties, ranked_groups, share_of_total, running_year,
    last_year, rolling_quarter, period_buckets, calendar, except_and_intersect, distinct_values, domain_cardinality, looked_up, text_scalars, math_scalars, date_scalars, detail,
    event_counts, over_limit, both_roles, measure_filter_replaces, measure_filter_over_groups, kept_filter, measure_order, unrelated_dimension, measure_of_measures, all_except,
    year_month_pairs, iterated, counts, inspected, edge_values, summarized, related_rows, generated, combined_tables, distinct_tuples, up_and_down, looked_up_pair, domain_values, logic_scalars, number_scalars,
    more_text, more_dates, formats, day_shifts, period_edges, month_to_date, last_days, quarter_buckets, nearest_vectors, text_chunks, name_similarity, request_limits,
    last_quarters, default_semesters, periods_compared, covered_periods, hard_ranked, blank_group_share, listed_values,
)}

_LI = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"
_P, _N, _Q = "sum(l_extendedprice::DECIMAL(18,4))::DOUBLE", "sum(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(6,4)))::DOUBLE", "sum(l_quantity::DECIMAL(18,4))::DOUBLE"
_MONTHS = "m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,4)) AS value FROM orders GROUP BY 1)"

_DAYS = "d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value FROM orders GROUP BY 1)"

ORACLE_SQL = {
    "scalar_measures": f"SELECT l.*, o.* FROM (SELECT {_P} AS revenue, {_N} AS net_revenue, {_Q} AS quantity, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines FROM lineitem) l, (SELECT count(*) AS orders_placed, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS order_value, count(DISTINCT o_custkey) AS buyers FROM orders) o",
    "grouped_measures": f"SELECT r_name, p_brand, {_P} AS revenue, count(*) AS lines FROM {_LI} GROUP BY ALL",
    "filtered_context": f"SELECT n_name, {_N} AS net_revenue, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS returned_lines FROM {_LI} WHERE lower(c_mktsegment) IN ('building', 'machinery') AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL",
    "replaced_filter": "SELECT o_orderpriority, count(*) AS orders_placed, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS order_value FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL",
    "two_facts": f"SELECT c_mktsegment, revenue, orders_placed, buyers FROM (SELECT c_mktsegment, {_P} AS revenue FROM {_LI} GROUP BY ALL) FULL JOIN (SELECT c_mktsegment, count(*) AS orders_placed, count(DISTINCT o_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (c_mktsegment)",
    "both_directions": """
        WITH hit AS (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#13')),
        o AS (SELECT orders.*, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (FROM hit)),
        by_order AS (SELECT c_mktsegment, count(*) AS orders_placed, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS order_value FROM o GROUP BY ALL),
        by_line AS (SELECT c_mktsegment, count(*) AS lines FROM hit JOIN o ON l_orderkey = o_orderkey GROUP BY ALL),
        by_customer AS (SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o) GROUP BY ALL)
        SELECT * FROM by_customer FULL JOIN by_order USING (c_mktsegment) FULL JOIN by_line USING (c_mktsegment)""",
    "removed_filter": f"SELECT p_brand, (sum(l_extendedprice::DECIMAL(18,4)) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS revenue, {_P} AS all_revenue FROM {_LI} GROUP BY ALL",
    "data_until": "SELECT l_returnflag, min(l_shipdate) AS first_shipment, max(l_shipdate) AS last_shipment FROM lineitem GROUP BY ALL",
    "role_playing": f"SELECT n_name, bought, sold FROM (SELECT n_name, {_Q} AS bought FROM {_LI} GROUP BY ALL) FULL JOIN (SELECT n_name, {_Q} AS sold FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) USING (n_name)",
    "top_with_ties": "SELECT p_brand, lines FROM (SELECT *, rank() OVER (ORDER BY lines DESC) AS r FROM (SELECT p_brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE r <= 5",
    "ranked_groups": "SELECT *, rank() OVER (PARTITION BY r_name ORDER BY orders_placed DESC)::INT AS rank FROM (SELECT r_name, n_name, count(*) AS orders_placed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)",
    "share_of_total": "SELECT c_mktsegment, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "running_year": f"WITH {_MONTHS} SELECT month::VARCHAR AS month, value::DOUBLE AS value, sum(value) OVER (PARTITION BY year(month) ORDER BY month)::DOUBLE AS ytd FROM m",
    "last_year": f"WITH {_MONTHS} SELECT a.month::VARCHAR AS month, a.value::DOUBLE AS value, b.value::DOUBLE AS year_before, round((a.value::DOUBLE - b.value::DOUBLE) / nullif(b.value::DOUBLE, 0), 8) AS change FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 12 MONTH",
    "rolling_quarter": f"WITH {_MONTHS} SELECT a.month::VARCHAR AS month, sum(b.value)::DOUBLE AS three_months FROM m a JOIN m b ON b.month <= a.month AND b.month > a.month - INTERVAL 3 MONTH GROUP BY 1",
    "period_buckets": "SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, count(*) AS orders_placed, 'Trim. ' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1997-01-01' GROUP BY ALL",
    "calendar": "SELECT year(d)::INT AS year, quarter(d)::INT AS quarter, count(*) AS days FROM (SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY ALL",
    "except_and_intersect": "WITH s AS (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) SELECT 'except' AS kind, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT * FROM s) UNION ALL SELECT 'intersect', count(*) FROM customer WHERE c_nationkey IN (SELECT * FROM s)",
    "distinct_values": "SELECT min(event_type) AS event_type FROM events GROUP BY lower(event_type)",
    "domain_cardinality": "SELECT count(DISTINCT lower(c_mktsegment)) AS c_mktsegment, count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT lower(c_name)) AS c_name FROM customer",
    "looked_up": "SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "text_scalars": "SELECT p_partkey, upper(p_name) AS up, CASE WHEN strpos(lower(p_name), 'e') > 0 THEN strpos(lower(p_name), 'e') ELSE -1 END::INT AS at, contains(lower(p_name), 'a') AS has, trim(regexp_replace(p_name || '  z ', ' +', ' ', 'g')) AS tidy, lower(p_name) || 'nandu' AS key, p_name || '-' || p_size AS joined FROM part",
    "math_scalars": "SELECT l_orderkey, l_linenumber, -l_quantity - l_linenumber * floor(-l_quantity / l_linenumber) AS modulo, trunc(l_quantity / 7) AS truncated, ceil(l_quantity / 7) AS up, round(l_quantity / nullif(l_linenumber - 1, 0), 8) AS divided, ceil(l_quantity / 5) * 5 AS ceiling, sign(l_quantity - 25)::DOUBLE AS sign FROM lineitem",
    "date_scalars": "SELECT o_orderkey, ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(o_orderdate)] AS month, ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow(o_orderdate)] AS day, isodow(o_orderdate)::INT AS weekday, last_day(o_orderdate + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_end, date_diff('month', o_orderdate::DATE, DATE '1999-01-01')::INT AS months, date_diff('quarter', o_orderdate::DATE, DATE '1999-01-01')::INT AS quarters FROM orders",
    "detail": "SELECT o_orderkey, n_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000",
    "event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "over_limit": "SELECT start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY ALL HAVING count(*) > 1",
    "both_roles": f"SELECT b.n_name AS buyer, s.n_name AS seller, {_Q} AS quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY ALL",
    "measure_filter_replaces": "SELECT p_brand, nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS lines, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS returned_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "measure_filter_over_groups": "SELECT *, round(returned_lines::DOUBLE / lines, 9) AS share_returned FROM (SELECT l_returnflag, count(*) AS lines, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned_lines FROM lineitem GROUP BY ALL)",
    "kept_filter": "SELECT l_returnflag, count(*) AS lines, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS kept FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL",
    "measure_order": f"SELECT l_returnflag, (SELECT {_P} FROM lineitem) AS all_revenue, {_P} AS revenue FROM lineitem GROUP BY ALL",
    "unrelated_dimension": f"SELECT p_brand, orders_placed, revenue FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand, {_P} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) USING (p_brand), (SELECT count(*) AS orders_placed FROM orders)",
    "measure_of_measures": f"SELECT r_name, round(({_P} / count(*)), 6) AS revenue_a_line, round((count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE / count(*), 9) AS share_returned FROM {_LI} GROUP BY ALL",
    "all_except": "WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT c_mktsegment, count(*) AS of_segment FROM o GROUP BY ALL) SELECT c_mktsegment, o_orderstatus, n AS orders_placed, of_segment FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) LEFT JOIN (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM o GROUP BY ALL) USING (c_mktsegment, o_orderstatus) LEFT JOIN g USING (c_mktsegment) WHERE n IS NOT NULL OR of_segment IS NOT NULL",
    "year_month_pairs": "SELECT year(o_orderdate)::INT AS o_year, month(o_orderdate)::INT AS o_month, c_mktsegment, count(*) AS orders_placed, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS order_value FROM orders JOIN customer ON o_custkey = c_custkey WHERE (year(o_orderdate), month(o_orderdate)) IN ((1995, 11), (1995, 12), (1996, 1), (1996, 2)) AND lower(c_mktsegment) IN ('building', 'furniture') GROUP BY ALL",
    "iterated": "SELECT r_name, avg(n) AS mean, median(n)::DOUBLE AS middle, min(n) AS low, max(n) AS high, count(n) AS nations FROM (SELECT r_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) GROUP BY ALL",
    "counts": "SELECT c_mktsegment, nullif(count(f), 0) AS known, nullif(count(*) FILTER (WHERE coalesce(f, '') = ''), 0) AS blank, count(DISTINCT lower(f)) + max((f IS NULL)::INT) AS kinds, count(DISTINCT lower(f)) AS kinds_known, count(*) = 0 AS none, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS middle FROM (SELECT *, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN '' ELSE o_orderpriority END AS f FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL",
    "inspected": "SELECT r_name, count(DISTINCT n_name) = 1 AS one, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) ELSE 'several' END AS nation, true AS filtered, true AS crossed, false AS part_crossed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') GROUP BY ALL",
    "edge_values": "SELECT c_mktsegment, min(o_orderdate) AS first_open, max(o_orderdate) AS last_open FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT 1) WHERE o_orderstatus = 'O' GROUP BY ALL",
    "summarized": "SELECT r_name, o_orderstatus, count(*) AS n, min(o_totalprice) AS least FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "related_rows": "SELECT c_custkey, n, most FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ALL) ON c_custkey = o_custkey",
    "generated": "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey",
    "combined_tables": "SELECT *, c_mktsegment || ' / ' || o_orderstatus AS label FROM (SELECT c_mktsegment, o_orderstatus FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT r_name, '-' FROM region)",
    "distinct_tuples": "SELECT DISTINCT p_brand, p_type FROM part",
    "up_and_down": "SELECT p_brand, lines, dense_rank() OVER (ORDER BY lines)::INT AS place FROM (SELECT *, rank() OVER (ORDER BY lines) AS r FROM (SELECT p_brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE r <= 7",
    "looked_up_pair": "SELECT p_brand, p_size, CASE WHEN x.p_brand = lower(x.p_brand) OR n IS NULL OR n <> 1 THEN 'several' ELSE t END AS p_type FROM (SELECT DISTINCT p_brand, p_size FROM part) x JOIN (SELECT lower(p_brand) AS b, p_size AS z, count(DISTINCT p_type) AS n, min(p_type) AS t FROM part GROUP BY ALL) ON lower(x.p_brand) = b AND p_size = z",
    "domain_values": "WITH v AS (SELECT 0 AS position, c_mktsegment AS value FROM customer UNION SELECT 1, c_nationkey::VARCHAR FROM customer UNION SELECT 2, c_name FROM customer) SELECT position, value FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY value) AS r FROM v WHERE value IS NOT NULL) WHERE r <= 50",
    "logic_scalars": "WITH l AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS x FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN x > 25 THEN 'high' ELSE 'low' END AS size, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS code, coalesce(x > 10, false) AND coalesce(x < 40, false) AS mid, coalesce(x > 45, false) AS top, NOT coalesce(x > 10, false) AS not_big, x IS NULL AS blank, x IS NOT NULL AS number, true AS text, true AS nontext, true AS logical, coalesce(x, -1) AS known, x AS plus, -2.0::DOUBLE AS tried, coalesce(x, 0) = 0 AS is_zero FROM l",
    "number_scalars": "SELECT l_orderkey, l_linenumber, round((l_extendedprice / 7)::DECIMAL(38,12), 2)::DOUBLE AS two, (sign(l_extendedprice) * floor(abs(l_extendedprice) / 100 + 0.5) * 100)::BIGINT AS hundreds, floor(-l_extendedprice / 3)::BIGINT AS whole, sign(-l_extendedprice / 3) * floor(abs(-l_extendedprice / 3) * 10.0::DOUBLE) / 10.0::DOUBLE AS down, trunc(l_extendedprice / 1000)::BIGINT AS quotient, round(pow(l_discount, 2), 9) AS square, round(sqrt(l_extendedprice), 6) AS root, round(log10(l_extendedprice), 9) AS log10, round(ln(l_extendedprice), 9) AS ln, floor(l_extendedprice / 250) * 250 AS floor, trunc(l_extendedprice)::BIGINT AS whole_number, l_linenumber::VARCHAR AS text, 12.5::DOUBLE AS value, l_extendedprice::DECIMAL(19,4)::DOUBLE AS currency FROM lineitem",
    "more_text": "SELECT p_partkey, left(p_name, 3) AS head, right(p_name, 2) AS tail, substr(p_name, 2, 3) AS inner, length(p_name)::INT AS length, replace(p_name, 'a', '-') AS put, 'abab' AS twice, p_name = upper(p_name) AS same, chr(p_size + 65) AS letter, substr(p_name, 1, 1) || '__' || substr(p_name, 4) AS cut, p_name || '||' || p_size AS row, CASE WHEN strpos(substr(p_name, 3), 'a') > 0 THEN strpos(substr(p_name, 3), 'a') + 2 ELSE 0 END::INT AS later, contains(p_name, 'A') AS has_upper FROM part",
    "more_dates": "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, strftime(ts, '%U')::INT + 1 AS week, (ts::DATE + INTERVAL 13 MONTH)::DATE::VARCHAR AS later, (date_trunc('year', ts) + to_months((month(ts) + 13)::INT) - INTERVAL 1 DAY)::DATE::VARCHAR AS rolled, trunc((epoch_us(date_trunc('second', TIMESTAMP '2024-03-01') ) // 1000000 - epoch_us(ts) // 1000000) / 3600)::BIGINT AS hours, trunc((epoch_us(TIMESTAMP '2024-03-01') // 1000000 - epoch_us(ts) // 1000000) / 60)::BIGINT AS minutes, ts::DATE::VARCHAR AS read, date_diff('day', DATE '2024-06-30', ts::DATE)::INT AS since FROM events",
    "formats": "SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS grouped, replace(o_totalprice::DECIMAL(18,2)::DECIMAL(18,1)::VARCHAR, '.', ',') AS plain, replace(printf('%.2f', round((o_totalprice / 1e6 * 100)::DECIMAL(38,12), 2)), '.', ',') || '%' AS percent, strftime(o_orderdate, '%d/%m/%Y') AS short, day(o_orderdate) || ' ' || ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(o_orderdate)] || ' ' || strftime(o_orderdate, '%y') AS long, quarter(o_orderdate) || '-' || year(o_orderdate) AS quarter FROM orders",
    "day_shifts": f"WITH {_DAYS} SELECT a.day::VARCHAR AS day, a.value, b.value AS week_before, (SELECT round(sum(value), 4) FROM d WHERE date_trunc('quarter', day) = date_trunc('quarter', a.day) - INTERVAL 3 MONTH) AS previous_quarter, (SELECT round(sum(value), 4) FROM d WHERE year(day) = year(a.day) + 1) AS next_year, c.value AS previous_day FROM d a LEFT JOIN d b ON b.day = a.day - 7 LEFT JOIN d c ON c.day = a.day - 1",
    "period_edges": "WITH o AS (SELECT o_orderdate::DATE AS day, o_orderstatus FROM orders WHERE o_orderdate >= '1995-02-10' AND o_orderdate < '1996-05-21'), s AS (SELECT o_orderstatus, min(day) AS a, max(day) AS b FROM o GROUP BY ALL) SELECT o_orderstatus, a::VARCHAR AS first_date, b::VARCHAR AS last_date, (SELECT min(day) FROM o WHERE date_trunc('quarter', day) = date_trunc('quarter', a))::VARCHAR AS start_of, (SELECT max(day) FROM o WHERE date_trunc('quarter', day) = date_trunc('quarter', b))::VARCHAR AS end_of FROM s",
    "month_to_date": f"WITH {_DAYS} SELECT day::VARCHAR AS day, round(sum(value) OVER (PARTITION BY date_trunc('month', day) ORDER BY day), 4) AS mtd, round(sum(value) OVER (PARTITION BY date_trunc('quarter', day) ORDER BY day), 4) AS qtd FROM d",
    "last_days": f"WITH {_DAYS} SELECT day::VARCHAR AS day, round(sum(value) OVER (ORDER BY day RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW), 4) AS ten_days FROM d",
    "quarter_buckets": "SELECT b::DATE::VARCHAR AS bucket, (SELECT sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders WHERE date_trunc('quarter', o_orderdate) = b AND o_orderdate >= '1991-05-15' AND o_orderdate < '1993-08-21') AS value FROM (SELECT unnest(generate_series(TIMESTAMP '1991-04-01', TIMESTAMP '1993-07-01', INTERVAL 3 MONTH)) AS b)",
    "last_quarters": "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value FROM orders WHERE o_orderdate >= '1996-10-01' AND o_orderdate < '1997-07-01' GROUP BY ALL",
    "default_semesters": "SELECT CASE WHEN month(o_orderdate) > 6 THEN year(o_orderdate) || '-07-01' ELSE year(o_orderdate) || '-01-01' END AS semester, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value FROM orders WHERE o_orderdate >= '1996-07-01' AND o_orderdate < '1997-07-01' GROUP BY ALL",
    "periods_compared": "SELECT o_orderpriority, (sum(o_totalprice::DECIMAL(18,4)) FILTER (WHERE year(o_orderdate) IN (1995, 1996)))::DOUBLE AS last_years, (sum(o_totalprice::DECIMAL(18,4)) FILTER (WHERE o_orderdate >= '1997-05-01' AND o_orderdate < '1997-08-16'))::DOUBLE AS since_may FROM orders WHERE year(o_orderdate) IN (1995, 1996) OR (o_orderdate >= '1997-05-01' AND o_orderdate < '1997-08-16') GROUP BY ALL",
    "covered_periods": "SELECT o_custkey, min(o_orderdate)::DATE <= DATE '1993-01-01' AND max(o_orderdate)::DATE + 1 >= DATE '1993-12-31' AS has_year, min(o_orderdate)::DATE <= DATE '1994-03-11' AND max(o_orderdate)::DATE + 1 >= DATE '1994-03-10' AS has_day FROM orders GROUP BY ALL",
    "hard_ranked": "SELECT o_custkey, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value FROM orders GROUP BY ALL ORDER BY value DESC, o_custkey LIMIT 7",
    "blank_group_share": "SELECT blank, total, round(blank / total, 9) AS share FROM (SELECT (sum(l_quantity::DECIMAL(18,4)) FILTER (WHERE l_returnflag = 'N'))::DOUBLE AS blank, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS total FROM lineitem) WHERE blank / total >= 0.1",
    "listed_values": "SELECT value, total, total > 10 AS is_cut FROM (SELECT DISTINCT p_brand AS value FROM part) CROSS JOIN (SELECT count(DISTINCT p_brand) AS total FROM part) ORDER BY lower(value) LIMIT 10",
    "nearest_vectors": "SELECT query, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE place <= 5",
    "request_limits": "SELECT event_id, user_id, n, CASE WHEN n > 2 AND frees + 3600 > sec THEN round(frees + 3600 - sec, 6) END AS wait FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n, lag(epoch_us(ts) / 1e6, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frees FROM events)",
}

for _module in (catalogue, contexts, documents, language, reports, retrieval, streams):
    QUERIES |= {f.__name__: plain_types(f) for f in _module.QUERY_LIST}
    ORACLE_SQL |= _module.ORACLE_SQL
