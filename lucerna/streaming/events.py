"""Event streams: counts by window, duplicates dropped, and a sliding limit. Each works on a batch or a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark if streaming, which asks for a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def counted(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling windows; (start, event_type, n) on a batch and on a stream."""
    e = timed(events, late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def over_limit(events: DataFrame, limit: int, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Users with more than limit events in a sliding window."""
    e = timed(events, late)
    return e.groupBy(F.window("ts", width, slide).alias("w"), "user_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """A sliding log: each event with the number of its user's events in the last seconds, itself included, and, over
    the limit, the seconds until one of them is old enough for a slot to be free. A batch: users are worked on apart."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    last = Window.partitionBy("user_id").orderBy("__at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    e = events.withColumn("__at", at).withColumn("n", F.count("*").over(last))
    by_place = Window.partitionBy("user_id").orderBy("__at", "event_id")
    frees = F.lag("__at", limit).over(by_place)
    wait = (frees + seconds * 1_000_000 - F.col("__at")) / 1e6
    return e.withColumn("wait", F.when((F.col("n") > limit) & (wait > 0), wait)).drop("__at")
