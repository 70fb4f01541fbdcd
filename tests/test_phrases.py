"""Spans of time and groupings in Spanish questions."""

import pytest
from pyspark.sql import functions as F

from lucerna.functions import phrases as P

TODAY = "2026-10-09"
SPANS = {
    "peso de lavanderia entre enero y marzo de 2025": ("2025-01-01", "2025-04-01"), "de enero a marzo del 2025": ("2025-01-01", "2025-04-01"), "desde noviembre de 2024 hasta febrero de 2025": ("2024-11-01", "2025-03-01"), "entre 2023 y 2025": ("2023-01-01", "2026-01-01"),
    "entre enero y marzo": ("2026-01-01", "2026-04-01"), "entre noviembre y diciembre": ("2025-11-01", "2026-01-01"), "de noviembre a febrero": ("2025-11-01", "2026-03-01"), "enero y marzo de 2025": ("2025-03-01", "2025-04-01"),
    "cuánto peso lleva la lavandería este año": ("2026-01-01", "2026-10-10"), "en lo que va del año": ("2026-01-01", "2026-10-10"), "el año pasado": ("2025-01-01", "2026-01-01"), "el año antepasado": ("2024-01-01", "2025-01-01"), "este mes": ("2026-10-01", "2026-10-10"),
    "el mes pasado": ("2026-09-01", "2026-10-01"), "marzo del año pasado": ("2025-03-01", "2025-04-01"), "este año en marzo": ("2026-03-01", "2026-04-01"), "primer trimestre de 2025": ("2025-01-01", "2025-04-01"), "el 1.er trimestre": ("2026-01-01", "2026-04-01"),
    "segundo trimestre del 2024": ("2024-04-01", "2024-07-01"), "cuarto trimestre": ("2026-10-01", "2026-10-10"), "primer semestre": ("2026-01-01", "2026-07-01"), "trimestre pasado": ("2026-07-01", "2026-10-01"), "ultimo trimestre de 2025": ("2025-10-01", "2026-01-01"), "q1 2025": ("2025-01-01", "2025-04-01"),
    "ultimos 3 meses": ("2026-07-01", "2026-10-01"), "los últimos doce meses": ("2025-10-01", "2026-10-01"), "ultimos 2 años": ("2024-01-01", "2026-01-01"), "ultimos 7 dias": ("2026-10-03", "2026-10-10"), "últimas dos semanas": ("2026-09-26", "2026-10-10"), "hoy": ("2026-10-09", "2026-10-10"), "ayer": ("2026-10-08", "2026-10-09"),
    "15 de marzo de 2025": ("2025-03-15", "2025-03-16"), "del 1 al 15 de marzo de 2025": ("2025-03-01", "2025-03-16"), "semana pasada": ("2026-09-28", "2026-10-05"), "desde marzo": ("2026-03-01", "2026-10-10"), "desde 2024": ("2024-01-01", "2026-10-10"), "cuanto peso hasta hoy": None,
    "peso 2025 junio": ("2025-06-01", "2025-07-01"), "en el mes de enero de 2026": ("2026-01-01", "2026-02-01"), "en enero": ("2026-01-01", "2026-02-01"), "cirugias programadas 2026": ("2026-01-01", "2027-01-01"), "octubre de 2026": ("2026-10-01", "2026-11-01"), "pacientes mayores de edad": None,
    "agosto comparado con septiembre": ("2026-08-01", "2026-10-01"), "septiembre vs octubre": ("2026-09-01", "2026-11-01"), "marzo frente a abril de 2025": ("2025-03-01", "2025-05-01"), "": None, "30 de febrero de 2025": ("2025-02-01", "2025-03-01"), "este trimestre": ("2026-10-01", "2026-10-10"), "esta semana": ("2026-10-05", "2026-10-10"),
}
OTHER_DAY = {
    "tiempo de respuesta en septiembre": ("2026-09-01", "2026-10-01"), "egresos en diciembre": ("2025-12-01", "2026-01-01"), "egresos en noviembre": ("2026-11-01", "2026-11-04"), "octubre vs noviembre": ("2026-10-01", "2026-12-01"), "esta semana": ("2026-11-02", "2026-11-04"), "la semana pasada": ("2026-10-26", "2026-11-02"),
}
UNITS = {"peso lavanderia 2025 por mes": "month", "evolucion mensual del peso": "month", "mes a mes": "month", "por trimestre": "quarter", "por año": "year", "promedio mensual de cirugias": None, "por mes de enero": None, "por servicio": None, "agosto contra septiembre": "month", None: None}


@pytest.mark.parametrize(("today", "cases"), [(TODAY, SPANS), ("2026-11-03", OTHER_DAY), ("2026-02-10", {"tercer trimestre": ("2025-07-01", "2025-10-01")})])
def test_spans(spark, today, cases):
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    got = {r["q"]: r["p"] and (str(r["p"]["start"]), str(r["p"]["end"])) for r in P.period(df, "q", today, "p").collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {}


def test_months_of_every_year(spark):
    cases = {"entre enero y marzo de todos los años": [1, 2, 3], "egresos en marzo de todos los anos": [3], "egresos de marzo por ano": [3], "histórico de egresos en marzo": [3], "de noviembre a enero de cada año": [11, 12, 1]}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["p"]["months"] for r in P.period(df, "q", TODAY, "p").collect()} == cases


def test_groupings(spark):
    df = spark.createDataFrame([(k,) for k in UNITS], "q string")
    assert {r["q"]: r["u"] for r in P.period(df, "q", TODAY).select("q", P.granularity("q", F.col("period.compare")).alias("u")).collect()} == UNITS
    assert P.period(df.where("q is null"), "q", TODAY, "p").first()["p"] is None
