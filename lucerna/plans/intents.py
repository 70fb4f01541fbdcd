"""What a question about documents is after: its intent, what kinds of chunks answer it, and the report or page it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain
from .lexical_index import GENERIC, stemmed, tokenized

# Patterns of Spanish questions by intent, the first that fits counts.
INTENTS = {
    "technical": r"\bsql\b|\bquer(?:y|ies)\b|\bconsultas? (?:sql|tecnicas?)\b|\b(?:origen|fuente) de (?:los )?datos\b|\bbase de datos\b|\bque tablas?\b|\btablas? (?:de origen|origen|fuente)\b|\bcolumnas?\b|\bde donde (?:salen|se obtienen|vienen)\b",
    "filters": r"\bfiltr|\bsegment",
    "calculation": r"\bcomo se (?:calcula|obtiene|mide)|\bcomo calcula|\bformula|\bcalcul|\bexpresion\b|\bdax\b",
    "overview": r"\bque (?:muestra|informacion|contiene|indicadores|puedo ver|hay en|se ve\b)|\bpara que sirve|\bde que trata|\bque tiene el tablero|\bq(?:ue)? es el tablero|\bdescrib|\bdescripcion",
    "definition": r"\bque significa|\bsignificado|\bq(?:ue)? es\b|\bque son\b|\bque indica|\brangos?\b|\bcolor|\bsemaforo|\bcategorias?\b|\bniveles?\b",
}
# What kinds of chunks are worth, in general and by intent.
PRIOR = {"dashboard_overview": 0.04, "document_section": 0.05, "documented_measure": 0.05, "indicator": 0.04, "filter": 0.03, "visual": 0.02, "measure": 0.0, "calculated_column": -0.03, "table_context": -0.12, "sql_query": -0.20}
BONUS = {
    "overview": {"dashboard_overview": 0.14, "visual": 0.03, "document_section": 0.03}, "filters": {"filter": 0.12, "dashboard_overview": 0.06, "visual": 0.03},
    "calculation": {"documented_measure": 0.14, "measure": 0.10, "calculated_column": 0.06, "indicator": 0.06, "document_section": 0.03},
    "definition": {"document_section": 0.05, "documented_measure": 0.05, "visual": 0.03, "dashboard_overview": 0.03, "indicator": 0.04, "business_rule": 0.10, "definition": 0.10},
    "technical": {"sql_query": 0.24, "table_context": 0.16, "calculated_column": 0.05}, "general": {},
}


def intent(text: Column | str) -> Column:
    folded = F.regexp_replace(plain(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.coalesce(*(F.when(folded.rlike(p), k) for k, p in INTENTS.items()), F.lit("general"))


def prior(kind: Column | str, intent_: Column | str) -> Column:
    """What a chunk's kind adds to its score under an intent."""
    kind, intent_ = (F.col(c) if isinstance(c, str) else c for c in (kind, intent_))
    base = F.create_map(*(F.lit(x) for kv in PRIOR.items() for x in kv))
    more = F.create_map(*(x for i, own in BONUS.items() for k, v in own.items() for x in (F.lit(f"{i}/{k}"), F.lit(v))))
    return F.coalesce(base[kind], F.lit(0.0)) + F.coalesce(more[F.concat_ws("/", intent_, kind)], F.lit(0.0))


def scopes(questions: DataFrame, names: DataFrame, id_: str, name: str, kind: str, group: str) -> DataFrame:
    """(id, kind, name, groups): the report or page that a question names: all words of the name that tell it apart are in
    the question; the longest name wins, then a report before a page. names: (name, kind, group), text in `text`."""
    generic = sorted({stemmed(g) for g in GENERIC})
    own = tokenized(names.select(name).distinct(), name, name).select(name, F.array_sort(F.array_distinct(F.filter("words", lambda w: ~w.isin(*generic)))).alias("__w")).where(F.size("__w") > 0)
    each = own.select(name, F.size("__w").alias("__n"), F.explode("__w").alias("word"))
    asked = tokenized(questions, id_).select(id_, F.explode(F.array_distinct("words")).alias("word"))
    full = asked.join(each, "word").groupBy(id_, name, "__n").agg(F.count("*").alias("__hit")).where("__hit = __n")
    found = full.join(names.groupBy(name, kind).agg(F.sort_array(F.collect_set(group)).alias("groups")), name)
    w = Window.partitionBy(id_).orderBy(F.desc("__n"), F.when(F.col(kind) == "report", 0).otherwise(1), name)
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(id_, kind, name, "groups")


def weighed(scores: DataFrame, chunks: DataFrame, questions: DataFrame, query: str, chunk: str, kind: str, least: float = 0.35) -> DataFrame:
    """Scores (query, chunk, score) with their kind's prior under the question's intent; those below `least` go."""
    by = scores.join(chunks.select(chunk, kind), chunk).join(questions.select(query, intent("text").alias("intent")), query)
    return by.select(query, chunk, "intent", F.round(F.col("score") + prior(kind, "intent"), 6).alias("score")).where(F.col("score") >= least)
