"""Tables from Parquet, CSV and JSON lines, and model metadata from CSV files with bracketed headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Relationship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def metadata(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A metadata CSV; [Name] headers lose their brackets."""
    df = spark.read.csv(path, header=True, sep=separator, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿").strip("[]") for c in df.columns))


def relationships(df: DataFrame) -> list[Relationship]:
    """Metadata rows: as many as a model has relationships."""
    return [Relationship(r["FromTable"], r["FromColumn"], r["ToTable"], r["ToColumn"], str(r["IsActive"]).lower() == "true") for r in df.collect()]


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; what is there stays."""
    df.write.mode("append").json(path)


def replace_groups(spark: SparkSession, new: DataFrame, path: str, group: str, into: str) -> DataFrame:
    """The table at `path` with all rows of the groups that `new` has replaced by these, written to `into`."""
    old = spark.read.parquet(path)
    rest = old.join(new.select(F.col(group).alias("__g")).distinct(), F.col(group).eqNullSafe(F.col("__g")), "left_anti")
    rest.unionByName(new).write.mode("errorifexists").parquet(into)
    return spark.read.parquet(into)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, heading, text): the sections of Markdown files, those before the first heading too."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"\n(?=#{1,6} )")).alias("section", "part"))
    heading = F.regexp_extract("part", r"^\n?#{1,6} ([^\n]*)", 1)
    return parts.select("path", "section", F.trim(heading).alias("heading"), F.regexp_replace(F.regexp_replace("part", r"^\n?#{1,6} [^\n]*", ""), r"^\s+|\s+$", "").alias("text"))


def fixed_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)
