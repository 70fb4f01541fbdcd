"""Queries that run as streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import parquet
from ..sources.workspace import new_path
from ..streaming import state as ST


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, and an event of a far day that lets the watermark pass all others."""
    schema = parquet(spark, d, "events").schema
    end = new_path(spark, "end")
    parquet(spark, d, "events").limit(1).withColumns({"ts": F.lit("2200-01-01").cast("timestamp_ntz"), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")}).write.parquet(end)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.unionByName(spark.readStream.schema(schema).parquet(end))


def streamed_limits(spark, d):
    """The sliding limit on a stream: the rows of the batch."""
    out, checkpoint = new_path(spark, "limits"), new_path(spark, "checkpoint")
    ST.run_once(ST.limited(_stream(spark, d), 2, 3600), out, checkpoint)
    return spark.read.schema(ST.LIMITED).parquet(out).where("user_id >= 0").withColumn("wait", F.round("wait", 6))


def streamed_log(spark, d):
    """A log for each user that keeps three events and forgets all after four days without one: what is left."""
    out, checkpoint = new_path(spark, "log"), new_path(spark, "checkpoint")
    ST.run_once(ST.logged(_stream(spark, d), "user_id", "event_type", 3, 4 * 86400), out, checkpoint)
    changes = spark.read.schema(ST.CHANGES).parquet(out).where("stream >= 0")
    kinds = changes.groupBy("stream").agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("append", "trim")))
    return kinds.select("stream", F.col("append").alias("appended"), F.col("trim").alias("trimmed"))


def log_tail(spark, d):
    """The last three events of each user, without a stretch of four days before which nothing counts."""
    return ST.log_of(parquet(spark, d, "events"), "user_id", "event_type", 3, 4 * 86400)


QUERY_LIST = (streamed_limits, streamed_log, log_tail)

_E = "e AS (SELECT user_id AS stream, event_id, event_type AS event, epoch_us(ts) AS ts_us, row_number() OVER w AS \"offset\", epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 345600000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))"
ORACLE_SQL = {
    "streamed_limits": """SELECT event_id, user_id, n, CASE WHEN n > 2 AND frees + 3600 > sec THEN round(frees + 3600 - sec, 6) END AS wait FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n,
        lag(epoch_us(ts) / 1e6, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frees FROM events)""",
    "streamed_log": f"""WITH {_E}, g AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY stream ORDER BY "offset") AS part FROM e), r AS (SELECT stream, row_number() OVER (PARTITION BY stream, part ORDER BY "offset") AS place FROM g)
        SELECT stream, count(*) AS appended, count(*) FILTER (WHERE place > 3) AS trimmed FROM r GROUP BY ALL""",
    "log_tail": f"""WITH {_E}, b AS (SELECT stream, max("offset") AS last, coalesce(max("offset") FILTER (WHERE gap), 0) AS since FROM e GROUP BY ALL)
        SELECT stream, "offset", event_id, event, ts_us FROM e JOIN b USING (stream) WHERE "offset" > last - 3 AND "offset" >= since""",
}
