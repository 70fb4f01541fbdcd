"""Word documents as blocks, metadata and conversations as files, model folders, and the registry of metrics.

Files are read by Spark, each by the task that has it; a file that is no document has no blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, place int, kind string, style string, text string, cells array<array<string>>"


def said(element: ElementTree.Element) -> str:
    """The text of a paragraph or cell, with single spaces."""
    parts = []
    for e in element.iter():
        if e.tag == f"{WORD}t":
            parts.append(e.text or "")
        elif e.tag in (f"{WORD}tab", f"{WORD}br", f"{WORD}p"):
            parts.append(" ")
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def blocks_of(content: bytes) -> list[tuple]:
    """(place, kind, style, text, cells) of a document's paragraphs with text and of its tables, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
            styles = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                    name = s.find(f"{WORD}name")
                    styles[s.get(f"{WORD}styleId")] = name.get(f"{WORD}val") if name is not None else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out, place = [], 0
    for child in body if body is not None else ():
        if child.tag == f"{WORD}p":
            style = child.find(f"{WORD}pPr/{WORD}pStyle")
            id_ = style.get(f"{WORD}val") if style is not None else None
            if text := said(child):
                out.append((place, "paragraph", styles.get(id_, id_), text, None))
        elif child.tag == f"{WORD}tbl":
            out.append((place, "table", None, None, [[said(c) for c in row.findall(f"{WORD}tc")] for row in child.findall(f"{WORD}tr")]))
        else:
            continue
        place += 1
    return out


def docx(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the .docx files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))]
        for b in batches:
            for i in range(b.num_rows):
                name, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows = [(name, *row) for row in blocks_of(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "place", "kind", "style", "text", "cells"])

    return files.mapInArrow(cut, BLOCKS)


def clean(text: Column | str) -> Column:
    """Single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\s ]+", " "))


def sections(blocks: DataFrame) -> DataFrame:
    """The document's normal form: (path, section, heading, level, text, tables): what comes under each heading, by style
    "heading n"; what comes before the first is section 0 without a heading."""
    level = F.regexp_extract(F.lower(F.coalesce("style", F.lit(""))), r"^heading (\d)", 1).try_cast("int")
    w = Window.partitionBy("path").orderBy("place")
    b = blocks.withColumn("level", F.when(F.col("kind") == "paragraph", level)).withColumn("section", F.count("level").over(w))
    rows = F.transform(F.col("cells"), lambda r: F.array_join(r, " | "))
    said_ = F.when(F.col("level").isNull() & (F.col("kind") == "paragraph"), F.struct("place", clean("text").alias("text")))
    table = F.when(F.col("kind") == "table", F.struct("place", F.array_join(rows, "\n").alias("text")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda p: p["text"])
    return b.groupBy("path", "section").agg(
        F.max(F.when(F.col("level").isNotNull(), clean("text"))).alias("heading"), F.max("level").alias("level"), F.array_join(texts(said_), "\n").alias("text"), texts(table).alias("tables"),
    )


def write_metadata(df: DataFrame, path: str) -> None:
    """A metadata CSV: headers in brackets, as `metadata` of the files reads it."""
    df.toDF(*(f"[{c}]" for c in df.columns)).write.mode("overwrite").csv(path, header=True, encoding="UTF-8", quoteAll=True)


def discovered(spark: SparkSession, roots: list[str], file: str) -> DataFrame:
    """(model, path): folders of models below several roots, those that hold a metadata file; a model's name folds to its
    key, and the first root that has it wins."""
    out = None
    for i, root in enumerate(roots):
        found = spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("path"))
        part = found.select(F.lit(i).alias("__root"), F.try_url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("__name"), "path").distinct()
        out = part if out is None else out.union(part)
    key = F.regexp_replace(F.regexp_replace(plain(F.col("__name")), "[^a-z0-9]+", "_"), "^_|_$", "")
    w = Window.partitionBy("model").orderBy("__root", "path")
    return out.withColumn("model", key).withColumn("__r", F.row_number().over(w)).where("__r = 1").select("model", "path")


def exported(messages: DataFrame, conversation: str, order: str, role: str, text: str, names: dict[str, str]) -> DataFrame:
    """(conversation, markdown): each conversation as one document, a heading for each message; roles without a name keep
    theirs, null texts are empty."""
    shown = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col(role)], F.col(role), F.lit(""))
    part = F.struct(F.col(order).alias("o"), F.concat(F.lit("## "), shown, F.lit("\n\n"), F.trim(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    return messages.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("markdown"))


def registry(measures: DataFrame, visuals: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(model, metric, table, kind, aggregation, shown): explicit measures (model, table, name, hidden), one for each key,
    hidden ones only if a visual shows them, and aggregations that visuals make of columns (model, report, page, table,
    name, aggregation; null: of a measure). Rows of models that have none here are kept from the old registry."""
    shown = visuals.select("model", F.lower("name").alias("__n")).distinct().withColumn("shown", F.lit(True))
    own = measures.groupBy("model", "table", F.lower("name").alias("__n")).agg(F.min("name").alias("metric"), F.min("hidden").alias("hidden"))
    explicit = own.join(shown, ["model", "__n"], "left").where("not coalesce(hidden, false) or shown")
    explicit = explicit.select("model", "metric", "table", F.lit("measure").alias("kind"), F.lit(None).cast("string").alias("aggregation"), F.coalesce("shown", F.lit(False)).alias("shown"))
    made = visuals.where("aggregation is not null").groupBy("model", "report", "page", "table", F.lower("name").alias("__n"), "aggregation").agg(F.min("name").alias("metric"))
    made = made.select("model", "metric", "table", F.lit("visual").alias("kind"), "aggregation", F.lit(True).alias("shown")).distinct()
    new = explicit.union(made)
    if old is None:
        return new
    return new.unionByName(old.join(new.select("model").distinct(), "model", "left_anti"))
