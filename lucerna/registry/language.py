"""Queries of words: spans in questions, typing errors, names meant, questions alike, values in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching as MT
from ..functions import phrases as PH
from ..functions import spelling as SP
from ..functions.scalars import month_name
from ..operators import tables as T
from ..plans import naming as NM
from ..plans import similar as SM
from ..sources.files import parquet

TODAY = "2000-10-09"


def question_spans(spark, d):
    """Questions made of each order's date in twelve forms, and the span and grouping that they ask for."""
    o = parquet(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    y, m, dd, q = F.year("day").cast("string"), month_name(F.col("day")), F.dayofmonth("day").cast("string"), F.quarter("day")
    forms = [
        F.concat(F.lit("ventas de "), m, F.lit(" de "), y), F.concat(F.lit("¿Cuánto fue en "), y, F.lit("?")), F.concat(F.lit("pedidos del "), dd, F.lit(" de "), m, F.lit(" de "), y), F.concat(F.lit("entre enero y "), m, F.lit(" del "), y),
        F.concat(F.lit("desde "), m, F.lit(" de "), y, F.lit(" por mes")), F.concat(F.element_at(F.array(*map(F.lit, ("Primer", "segundo", "tercer", "CUARTO"))), q), F.lit(" trimestre de "), y), F.concat(F.lit("entre "), y, F.lit(" y 2001 por año")), F.concat(F.lit("ventas en "), m),
        F.concat(F.lit("los últimos "), F.month("day").cast("string"), F.lit(" meses, mes a mes")), F.concat(m, F.lit(" de todos los años")), F.concat(m, F.lit(" de "), y, F.lit(" contra enero de 1994")), F.lit("cuántas ventas hubo"),
    ]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int"))
    df = PH.period(o.withColumn("text", text), "text", TODAY)
    return df.select("o_orderkey", "text", F.col("period.kind").alias("kind"), F.col("period.start").cast("string").alias("start"), F.col("period.end").cast("string").alias("end"), F.array_join("period.months", ",").alias("months"), PH.granularity("text", F.col("period.compare")).alias("unit"))


def corrected_words(spark, d):
    """Words of documents with a letter left out, doubled or swapped, put right by the vocabulary of all documents' words."""
    vocabulary = SP.words_of(parquet(spark, d, "documents").where("lang = 'es'"), "text").where("length(word) between 5 and 20")
    kind = F.pmod(F.crc32("word"), F.lit(3))
    typo = F.when(kind == 0, F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)"))).when(kind == 1, F.concat(F.substring("word", 1, 3), F.expr("substring(word, 3)"))).otherwise(F.concat(F.substring("word", 1, 2), F.substring("word", 4, 1), F.substring("word", 3, 1), F.expr("substring(word, 5)")))
    planted = vocabulary.select(typo.alias("typo"))
    return SP.corrections(planted, vocabulary, "typo", "word")


def tidy_questions(spark, d):
    """Chat questions about parts: signs, short forms, letters repeated; put right against the names of parts."""
    part = parquet(spark, d, "part")
    text = F.concat(F.lit("  q   valor x "), F.split("p_name", " ")[0], F.lit(" ,k pasa  con "), F.regexp_replace("p_name", "(.)$", "$1$1$1"), F.lit("??cant d "), F.lower("p_type"))
    names = T.values(part, "p_name").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return SP.normalised(part.select("p_partkey", text.alias("text")), names, "p_partkey", "text", "word")


def resolved_names(spark, d):
    """Which part name a question means; the names themselves as phrases, with the words around them or apart."""
    part = parquet(spark, d, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("¿Cuántas unidades de "), F.upper("p_name"), F.lit(" hay?"))).otherwise(F.concat(second, F.lit(" de color "), first))
    return NM.resolved(part.select("p_partkey", text.alias("text")), part.select("p_name").distinct(), "p_partkey", "text", "p_name")


def similar_names(spark, d):
    """Distinct names and kinds of parts whose trigrams have a cosine of 0.77 or more."""
    texts = parquet(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") < 10, F.col("p_brand"))).alias("text"))
    return SM.alike(texts, "text", 0.77).select("a", "b", "cosine")


def value_matches(spark, d):
    """The words of documents' first lines in texts of documents: of each document the opening of another that it covers."""
    docs = parquet(spark, d, "documents")
    opening = F.array_join(F.slice(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), 1, 4), " ")
    values = docs.select(F.trim(opening).alias("value")).where("value <> ''").distinct()
    return MT.matched_values(docs.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text")), values, "doc_id", "text", "value", 0.7).select("doc_id", "value", F.round("score", 6).alias("score"))


QUERY_LIST = (question_spans, corrected_words, tidy_questions, resolved_names, similar_names, value_matches)

_NAMES = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"
ORACLE_SQL = {
    "question_spans": f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, {_NAMES}[month(o_orderdate)] AS n, o_orderkey % 12 AS k FROM orders),
        f AS (SELECT *, date_trunc('month', day)::DATE AS ms, make_date(CASE WHEN m <= 10 THEN 2000 ELSE 1999 END, m, 1) AS recent FROM o),
        t AS (SELECT *, CASE k WHEN 0 THEN 'ventas de ' || n || ' de ' || y WHEN 1 THEN '¿Cuánto fue en ' || y || '?' WHEN 2 THEN 'pedidos del ' || day(day) || ' de ' || n || ' de ' || y WHEN 3 THEN 'entre enero y ' || n || ' del ' || y WHEN 4 THEN 'desde ' || n || ' de ' || y || ' por mes'
            WHEN 5 THEN ['Primer', 'segundo', 'tercer', 'CUARTO'][quarter(day)] || ' trimestre de ' || y WHEN 6 THEN 'entre ' || y || ' y 2001 por año' WHEN 7 THEN 'ventas en ' || n WHEN 8 THEN 'los últimos ' || m || ' meses, mes a mes' WHEN 9 THEN n || ' de todos los años' WHEN 10 THEN n || ' de ' || y || ' contra enero de 1994' ELSE 'cuántas ventas hubo' END AS text,
            CASE k WHEN 0 THEN ms WHEN 1 THEN make_date(y, 1, 1) WHEN 2 THEN day WHEN 3 THEN make_date(y, 1, 1) WHEN 4 THEN ms WHEN 5 THEN date_trunc('quarter', day)::DATE WHEN 6 THEN make_date(y, 1, 1) WHEN 7 THEN recent WHEN 8 THEN (DATE '2000-10-01' - to_months(m::INT))::DATE WHEN 10 THEN DATE '1994-01-01' END AS a,
            CASE k WHEN 0 THEN ms + INTERVAL 1 MONTH WHEN 1 THEN make_date(y + 1, 1, 1) WHEN 2 THEN day + 1 WHEN 3 THEN ms + INTERVAL 1 MONTH WHEN 4 THEN DATE '2000-10-10' WHEN 5 THEN date_trunc('quarter', day) + INTERVAL 3 MONTH WHEN 6 THEN DATE '2002-01-01' WHEN 7 THEN CASE WHEN m = 10 THEN DATE '2000-10-10' ELSE recent + INTERVAL 1 MONTH END WHEN 8 THEN DATE '2000-10-01' WHEN 10 THEN ms + INTERVAL 1 MONTH END::DATE AS b FROM f),
        g AS (SELECT *, a IS NOT NULL AND a < b AND NOT (k = 10 AND a = ms) AS fits FROM t)
        SELECT o_orderkey, text, CASE WHEN k = 9 THEN 'months' WHEN k = 4 AND NOT fits OR fits THEN 'span' END AS kind, CASE WHEN fits THEN a::VARCHAR WHEN k = 4 THEN ms::VARCHAR END AS start, CASE WHEN fits THEN b::VARCHAR WHEN k = 4 THEN (ms + INTERVAL 1 MONTH)::DATE::VARCHAR END AS "end",
            CASE WHEN k = 9 THEN m::VARCHAR END AS months, CASE WHEN k IN (4, 8, 10) THEN 'month' WHEN k = 6 THEN 'year' END AS unit FROM g""",
    "similar_names": """WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(concat_ws(' ', p_name, p_type, CASE WHEN p_size < 10 THEN p_brand END)), '[^a-z0-9%]+', ' ', 'g')) AS t FROM part),
        g AS (SELECT t, substr('  ' || t || '  ', i, 3) AS gram, count(*) AS n FROM (SELECT t, unnest(generate_series(1, length(t) + 2)) AS i FROM t) GROUP BY ALL), s AS (SELECT t, sqrt(sum(n * n)) AS s FROM g GROUP BY ALL),
        d AS (SELECT a.t AS a, b.t AS b, sum(a.n * b.n) AS dot FROM g a JOIN g b USING (gram) WHERE a.t < b.t GROUP BY ALL)
        SELECT a, b, round(dot / (x.s * y.s), 6) AS cosine FROM d JOIN s x ON x.t = a JOIN s y ON y.t = b WHERE dot / (x.s * y.s) >= 0.77""",
    "value_matches": """WITH w AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS t FROM documents), v AS (SELECT DISTINCT trim(array_to_string(string_split(t, ' ')[1:4], ' ')) AS value FROM w), vv AS (SELECT value, list_distinct(string_split(value, ' ')) AS words FROM v WHERE value <> ''),
        ve AS (SELECT value, len(words) AS n, unnest(words) AS word FROM vv), de AS (SELECT DISTINCT doc_id, unnest(string_split(t, ' ')) AS word FROM w),
        h AS (SELECT doc_id, value, n, count(*) / n AS score FROM de JOIN ve USING (word) GROUP BY doc_id, value, n)
        SELECT doc_id, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, value) AS r FROM h WHERE score >= 0.7) WHERE r = 1""",
}
