"""Texts that are alike: a join on the cosine of trigram counts with a prefix filter, scored by words and sequence too.

Equal texts are one. A text's trigrams are ordered from rare to frequent; its prefix is all before the rest's length falls
below the threshold, so two texts that reach it share a trigram of both prefixes: only those are joined. What two texts have
in common is added up over the rest of their trigrams in Arrow batches of candidate pairs, not over all pairs.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain
from ..sources.workspace import written
from .lexical_index import tokens as content_words

COSINE, COMBINED, SEQUENCE = 0.5, 0.62, 0.85
PAIRS = "a string, b string, cosine double, jaccard double, sequence double"


def normal(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(plain(F.col(text) if isinstance(text, str) else text), "[^a-z0-9%]+", " "))


def trigrams(text: str) -> Counter:
    padded = f"  {text}  "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def cosine(a: Counter, b: Counter) -> float:
    return sum(n * b[k] for k, n in a.items() if k in b) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def features(texts: DataFrame, text: str) -> DataFrame:
    """(text, gram, n): distinct normal texts, a row for each trigram."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, g, n) for t in b.column(0).to_pylist() for g, n in trigrams(t).items()]
            t, g, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(g, pa.string()), pa.array(n, pa.int64())], ["t", "gram", "n"])

    distinct = texts.select(normal(text).alias("t")).where("t <> ''").distinct()
    return distinct.mapInArrow(cut, "t string, gram string, n long")


def candidates(texts: DataFrame, text: str, least: float) -> DataFrame:
    """(a, b), a before b: pairs of normal texts that share a trigram of both prefixes."""
    each = written(features(texts, text))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("t").orderBy("df", "gram")
    rest = F.sum(F.col("n") * F.col("n")).over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("t"))
    # Kept as long as what is left from here on could reach the threshold by itself.
    prefix = each.join(df, "gram").select("t", "gram", rest.alias("rest"), whole.alias("whole")).where(F.col("rest") >= least * least * F.col("whole") * (1 - 1e-9)).select("t", "gram")
    a, b = prefix.withColumnRenamed("t", "a"), prefix.withColumnRenamed("t", "b")
    return a.join(b, "gram").where("a < b").select("a", "b").distinct()


def alike(texts: DataFrame, text: str, least: float = COSINE) -> DataFrame:
    """(a, b, cosine, jaccard, sequence) of all pairs of distinct normal texts whose cosine reaches `least`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (c := cosine(trigrams(a), trigrams(b))) >= least:
                    x, y = set(content_words(a)), set(content_words(b))
                    rows.append((a, b, round(c, 6), round(len(x & y) / len(x | y), 6) if x | y else 0.0, round(difflib.SequenceMatcher(None, a, b).ratio(), 6)))
            cols = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "cosine", "jaccard", "sequence"])

    return candidates(texts, text, least).mapInArrow(score, PAIRS)


def same_question(pairs: DataFrame) -> DataFrame:
    """The pairs that ask the same: words and trigrams together, or the sequence, reach their thresholds."""
    both = F.round((F.col("jaccard") + F.col("cosine")) / 2, 6)
    return pairs.withColumn("combined", both).where((F.col("combined") >= COMBINED) | (F.col("sequence") >= SEQUENCE))
