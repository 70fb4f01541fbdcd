"""Queries of documents' metadata: intents, names of reports, conversations as documents, registries, bands and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as T
from ..plans import intents as IN
from ..sources import documents as D
from ..sources.files import parquet

FORMS = {
    "technical": "de qué tablas salen las ventas de ", "filters": "Qué filtros tiene el tablero de ", "calculation": "cómo se calcula el total de ", "overview": "¿Qué muestra el informe ", "definition": "qué significa el color de ", "general": "ventas de ",
}


def _questions(spark, d):
    part = parquet(spark, d, "part").select("p_partkey", "p_name")
    text = F.element_at(F.array(*map(F.lit, FORMS.values())), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select("p_partkey", "p_name", F.concat(text, F.initcap("p_name")).alias("text"))


def question_intents(spark, d):
    """Intent of each question about a part, and what a chunk of two kinds is worth under it."""
    q = _questions(spark, d).withColumn("intent", IN.intent("text"))
    return q.select("p_partkey", "intent", F.round(IN.prior(F.lit("sql_query"), "intent"), 4).alias("sql"), F.round(IN.prior(F.lit("filter"), "intent"), 4).alias("filter"))


def named_scopes(spark, d):
    """The name that a question names: parts as pages, their first words as reports."""
    part = parquet(spark, d, "part")
    pages = part.select(F.col("p_name").alias("name"), F.lit("page").alias("kind"), F.col("p_brand").alias("group"))
    reports = part.select(F.concat(F.lit("Tablero "), F.split("p_name", " ")[0]).alias("name"), F.lit("report").alias("kind"), F.col("p_type").alias("group"))
    return IN.scopes(_questions(spark, d), pages.union(reports), "p_partkey", "name", "kind", "group").select("p_partkey", "kind", "name", F.size("groups").alias("groups"))


def exported_conversations(spark, d):
    """Conversations as Markdown documents: their length and a digest."""
    out = D.exported(parquet(spark, d, "conversations"), "conv_id", "turn", "role", "text", {"user": "Usuario", "assistant": "Asistente"})
    return out.select("conv_id", F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("digest"))


def metric_registry(spark, d):
    """A registry from parts: explicit measures by brand, some hidden, and aggregations that visuals make of columns."""
    part = parquet(spark, d, "part")
    measures = part.select(F.col("p_brand").alias("model"), F.lit("part").alias("table"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("hidden"))
    visuals = part.where("p_size % 3 = 0").select(F.col("p_brand").alias("model"), F.lit("r").alias("report"), F.col("p_type").alias("page"), F.lit("part").alias("table"), F.upper("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "SUM").alias("aggregation"))
    old = part.select(F.concat("p_brand", F.lit("-old")).alias("model"), F.col("p_name").alias("metric"), F.lit("part").alias("table"), F.lit("measure").alias("kind"), F.lit(None).cast("string").alias("aggregation"), F.lit(False).alias("shown")).union(part.select("p_brand", F.lit("gone"), F.lit("part"), F.lit("measure"), F.lit(None), F.lit(True))).distinct()
    return D.registry(measures, visuals, old).groupBy("model", "kind").agg(F.count("*").alias("n"), F.count_if("shown").alias("shown"), F.min(F.lower("metric")).alias("first"))


def banded_orders(spark, d):
    """GENERATESERIES as bands of value, CALENDAR as the days of a month and DATATABLE as names of states: orders in each,
    bands and days without any too."""
    o = parquet(spark, d, "orders")
    bands = T.series(spark, 0, 500000, 50000).withColumnRenamed("Value", "low")
    days = T.dates(spark, "1996-02-01", "1996-02-29")
    names = T.data_table(spark, "code string, state string", [("F", "finished"), ("O", "open"), ("X", "unknown")])
    by_band = bands.join(o.groupBy((F.floor(F.col("o_totalprice") / 50000) * 50000).alias("__b")).agg(F.count("*").alias("n")), F.col("low") == F.col("__b"), "left")
    by_day = days.join(o.groupBy(F.col("o_orderdate").cast("date").alias("__d")).agg(F.count("*").alias("n")), F.col("Date") == F.col("__d"), "left")
    by_state = names.join(o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), F.col("code") == F.col("o_orderstatus"), "left")
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    return row(by_band, "band", F.col("low").cast("long")).union(row(by_day, "day", F.col("Date"))).union(row(by_state, "state", F.col("state")))


QUERY_LIST = (question_intents, named_scopes, exported_conversations, metric_registry, banded_orders)

_CASE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(FORMS))
ORACLE_SQL = {
    "question_intents": f"""WITH q AS (SELECT p_partkey, CASE p_partkey % 6 {_CASE} END AS intent FROM part) SELECT p_partkey, intent, CASE WHEN intent = 'technical' THEN 0.04 ELSE -0.2 END::DOUBLE AS sql, CASE WHEN intent = 'filters' THEN 0.15 ELSE 0.03 END::DOUBLE AS filter FROM q""",
    "exported_conversations": """WITH m AS (SELECT conv_id, string_agg('## ' || CASE role WHEN 'user' THEN 'Usuario' WHEN 'assistant' THEN 'Asistente' ELSE coalesce(role, '') END || chr(10) || chr(10) || trim(coalesce(text, '')), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL)
        SELECT conv_id, length(t)::INT AS n_chars, sha256(t) AS digest FROM m""",
    "metric_registry": """WITH v AS (SELECT p_brand AS model, p_type AS page, lower(p_name) AS n, CASE WHEN p_size % 2 = 0 THEN 'SUM' END AS a FROM part WHERE p_size % 3 = 0),
        e AS (SELECT p_brand AS model, lower(p_name) AS n, min((p_size > 25)::INT) = 1 AS hidden FROM part GROUP BY ALL), x AS (SELECT model, n, (model, n) IN (SELECT model, n FROM v) AS shown FROM e WHERE NOT hidden OR (model, n) IN (SELECT model, n FROM v)),
        w AS (SELECT DISTINCT model, n, a FROM v WHERE a IS NOT NULL)
        SELECT model, 'measure' AS kind, count(*) AS n, count(*) FILTER (WHERE shown) AS shown, min(n) AS first FROM x GROUP BY ALL UNION ALL SELECT model, 'visual', count(*), count(*), min(n) FROM w GROUP BY ALL
        UNION ALL SELECT p_brand || '-old', 'measure', count(DISTINCT p_name), 0, min(p_name) FROM part GROUP BY p_brand""",
    "banded_orders": """SELECT 'band' AS kind, b::VARCHAR AS key, (SELECT count(*) FROM orders WHERE o_totalprice >= b AND o_totalprice < b + 50000) AS n FROM (SELECT unnest(generate_series(0, 500000, 50000)) AS b)
        UNION ALL SELECT 'day', d::DATE::VARCHAR, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = d) FROM (SELECT unnest(generate_series(DATE '1996-02-01', DATE '1996-02-29', INTERVAL 1 DAY)) AS d)
        UNION ALL SELECT 'state', s, (SELECT count(*) FROM orders WHERE o_orderstatus = c) FROM (VALUES ('F', 'finished'), ('O', 'open'), ('X', 'unknown')) AS t(c, s)""",
    "named_scopes": r"""WITH part2 AS (SELECT p_partkey, p_name, lower(p_name) AS n, string_split(p_name, ' ')[1] AS f, p_brand, p_type FROM part),
        st AS (SELECT *, list_sort(list_distinct(list_transform(string_split(n, ' '), lambda w: regexp_replace(w, '^(.{3,}[rlndzj])es$|^(.{3,})s$', '\1\2')))) AS w, regexp_replace(f, '^(.{3,}[rlndzj])es$|^(.{3,})s$', '\1\2') AS fw FROM part2),
        names AS (SELECT p_name AS name, 'page' AS kind, w, p_brand AS g FROM st UNION ALL SELECT 'Tablero ' || f, 'report', [fw], p_type FROM st),
        u AS (SELECT name, kind, any_value(w) AS w, count(DISTINCT g)::INT AS groups FROM names GROUP BY ALL)
        SELECT p_partkey, kind, name, groups FROM (SELECT p_partkey, u.kind, u.name, u.groups, row_number() OVER (PARTITION BY p_partkey ORDER BY len(u.w) DESC, CASE WHEN u.kind = 'report' THEN 0 ELSE 1 END, u.name) AS r FROM st JOIN u ON list_has_all(st.w, u.w)) WHERE r = 1""",
}
