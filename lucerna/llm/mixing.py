"""Mixing sources to target weights: subset-sum budget fitting on counts of documents by exact length.

A source's target is its share of the budget, by weight; a target stops at so many times its source's size, and what it
leaves is shared anew until none is above. Whole passes over a source come first. What the target asks for beyond them is
fitted on the histogram of lengths: each length gives its proportional share, rounded by largest remainders, up to a last
budget of about `SPAN` words, which a bounded knapsack fills exactly if any choice of the documents left does, else as
nearly as they allow (below before above). How many documents of a length go in once more is then a number; which ones is
decided by the order of a seeded hash of doc_id, so that reruns agree.

Only small rows move: texts are counted where they are read and stay there. Sources are ranked by a range partitioning and
the offsets of its partitions; shares come from a few sums; a source's histogram (a row for each length, not for each
document) is all that one task sees. The hash that ends a length's choice is found by descending: counts in 4096 ranges of
the hash, then hashes in one range, then rows of one hash, so no task ranks all documents of a common length.

Null and empty texts have size 0 and are taken 0 times 0 words; a null source is a source of its own, the last one; rows with
equal doc_id (or none) are documents of their own, those equal in all columns are interchangeable. An empty table gives no
rows. Columns other than doc_id, source and text are used only if asked for (`carry`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Words that the knapsack has to fill in each source, about; a source below that is left to the knapsack whole.
SPAN = 1 << 16
#: Cells of the knapsack's table at most. Documents longer than that which alone are left: the nearest of none and one.
CELLS = 1 << 23


@dataclass(frozen=True)
class Mix:
    """Weights by place of the source, repeating; the budget as a share of all sizes; how often a source goes in at most."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: int = 20240


def size_of(text: Column) -> Column:
    """Words: runs of anything but space and tab to carriage return."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The rows with `place`, from 0 by code point of source, null last. No task sees all: rows are sorted by ranges, and
    each range adds what the ranges before it hold."""
    order = F.col("source").asc_nulls_last()
    s = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id()))
    ranges = s.groupBy(F.shiftright("__id", 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    s = s.withColumn("__range", F.shiftright("__id", 33)).join(ranges.select("__range", before.alias("__before")), "__range")
    return s.withColumn("place", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__range", "__before")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) -> with `target`. Each round is one sum: sources above their limit leave it and keep that."""
    weight = F.element_at(F.array(*map(F.lit, map(float, mix.weights))), (F.col("place") % len(mix.weights) + 1).cast("int"))
    s = written(ranked(sources).withColumn("weight", weight).drop("place"))
    cap = F.lit(float(mix.most)) * F.col("source_size")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    left = budget = mix.share * total
    while weights:
        above = F.lit(left) * F.col("weight") / F.lit(weights) > cap
        full, rest = s.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if rest is None or (budget - mix.most * full, rest) == (left, weights):
            break
        left, weights = budget - mix.most * full, rest
    share = F.lit(left) * F.col("weight") / F.lit(weights or 1.0)
    return s.select("source", "source_size", F.least(share, cap).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int, top: int) -> np.ndarray:
    """How many of each length to take for a sum nearest to the goal, among sums up to `top`, below before above. Each
    length is one pass over the table: a sum is new if one reached before lies at most `count` steps of the length below;
    it keeps the length that reached it and the number of steps. Ends as soon as the goal is reached."""
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    via, used, taken = np.full(top + 1, -1, np.int32), np.zeros(top + 1, np.int32), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-(lengths * counts), kind="stable"):
        if reached[goal]:
            break
        step, count = int(lengths[k]), int(counts[k])
        if not 0 < step <= top or not count:
            continue
        rows = top // step + 1
        grid = np.zeros(rows * step, bool)
        grid[: top + 1] = reached
        grid = grid.reshape(rows, step)
        at = np.arange(rows, dtype=np.int64)[:, None]
        back = at - np.maximum.accumulate(np.where(grid, at, -count - 1), axis=0)
        new = ((back <= count) & ~grid).ravel()[: top + 1]
        via[new], used[new] = k, back.ravel()[: top + 1][new]
        reached |= new
    sums = np.flatnonzero(reached)
    at = int(sums[np.lexsort((sums, np.abs(sums - goal)))[0]])
    while at:
        k = via[at]
        taken[k] += used[at]
        at -= int(used[at]) * int(lengths[k])
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, target: float, most: int, span: int = SPAN) -> tuple[int, np.ndarray]:
    """(whole passes, how many documents of each length once more). Beyond half of the documents it is fitted which ones
    stay out, so that half of each length is free for the knapsack."""
    whole, goal = int((lengths * counts).sum()), int(np.floor(target + 0.5))
    passes = min(goal // whole, most) if whole else 0
    rest = goal - passes * whole
    if rest <= 0 or passes == most:
        return passes, np.zeros(len(lengths), np.int64)
    if 2 * rest > whole:
        return passes, counts - subset(lengths, counts, whole - rest, whole, span)
    return passes, subset(lengths, counts, rest, whole, span)


def subset(lengths: np.ndarray, counts: np.ndarray, rest: int, whole: int, span: int) -> np.ndarray:
    """How many documents of each length make `rest` words of `whole`: shares, then largest remainders, then the knapsack."""
    part = counts * (max(0, rest - span) / whole)
    extra = np.minimum(np.floor(part).astype(np.int64), counts)
    rest -= int((extra * lengths).sum())
    order, progress = np.lexsort((-lengths, np.floor(part) - part)), True
    while rest > span and progress:
        progress = False
        for k in order:
            if lengths[k] and extra[k] < counts[k] and rest - lengths[k] >= span // 2:
                extra[k] += 1
                rest -= int(lengths[k])
                progress = True
    free = counts - extra
    some = lengths[(free > 0) & (lengths > 0)]
    least = int(some.min()) if len(some) else 0
    if least and rest + least < CELLS:
        return extra + knapsack(lengths, free, rest, rest + least)
    if least and abs(rest - least) < rest:
        extra[np.flatnonzero((lengths == least) & (free > 0))[0]] += 1
    return extra


def plan_of(lengths: DataFrame, most: int) -> DataFrame:
    """(source, size, n, source_size, target) -> with the passes and extra documents of each length."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        passes, extra = fitted(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), most)
        return pdf.assign(passes=passes, extra=extra)

    return lengths.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, passes long, extra long")


def same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, Column]:
    """Right with its keys renamed, and the null-safe condition."""
    keys, on = list(keys), F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"__{k}")
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return right, on


def joined(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    keys = list(keys)
    right, on = same(left, right, keys)
    return left.join(right, on, how).drop(*(f"__{k}" for k in keys))


def edges(rows: DataFrame, need: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each group of keys, the value of `by` at which its first `need` rows end: (keys, by, need: how many rows of that
    value still belong to them, c: how many there are)."""
    counts = joined(rows.groupBy(*keys, by).agg(F.count("*").alias("c")), need, keys)
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("__before", before).where("__before < need and need <= __before + c")
    return at.select(*keys, by, (F.col("need") - F.col("__before")).alias("need"), "c")


def limits(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, last_hash, last_row): a length's extra documents are those up to here, in the order of hash and row."""
    need = plan.where("0 < extra and extra < n").select("source", "size", F.col("extra").alias("need"))
    keys = ["source", "size"]
    by_range = edges(sized, need, keys, "hash_range").drop("c")
    in_range = joined(sized, by_range.select(*keys, "hash_range"), [*keys, "hash_range"])
    by_hash = written(edges(in_range.select(*keys, "hash"), by_range.drop("hash_range"), keys, "hash"))
    last = by_hash.select(*keys, F.col("hash").alias("last_hash"), F.when(F.col("need") == F.col("c"), F.lit((1 << 63) - 1)).alias("last_row"))
    tied = by_hash.where("need < c")
    if not tied.limit(1).count():
        return last
    keys = [*keys, "hash"]
    rows = joined(sized, tied.select(*keys), keys)
    by_part = edges(rows, tied.drop("c"), keys, "part").drop("c")
    in_part = joined(rows, by_part.select(*keys, "part"), [*keys, "part"])
    by_row = edges(in_part, by_part.drop("part"), keys, "row")
    ends = by_row.select("source", "size", F.col("row").alias("__row"))
    return joined(last, ends, ["source", "size"], "left").select("source", "size", "last_hash", F.coalesce("last_row", "__row").alias("last_row"))


def mixed(docs: DataFrame, mix: Mix = Mix(), carry: Iterable[str] = ()) -> DataFrame:
    """(doc_id, source, carried columns, size, source_size, target, copies, taken), a row for each document: how often the
    mix takes it, and how many words that are. `repeated` gives the documents themselves."""
    carry = [c for c in carry if c not in ("doc_id", "source")]
    held = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    seeded = F.xxhash64("doc_id", F.lit(mix.seed))
    sized = written(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), *held)
        .withColumns({"hash": seeded, "hash_range": F.shiftright(seeded, 52), "row": F.monotonically_increasing_id()})
        .withColumn("part", F.shiftright("row", 33))
    )
    lengths = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = written(plan_of(joined(lengths, targets(sources, mix), ["source"]).select("source", "size", "n", "source_size", "target"), mix.most))
    plan = written(joined(plan, limits(sized, plan), ["source", "size"], "left"))
    once_more = (F.col("extra") == F.col("n")) | ((F.col("extra") > 0) & F.coalesce((F.col("hash") < F.col("last_hash")) | ((F.col("hash") == F.col("last_hash")) & (F.col("row") <= F.col("last_row"))), F.lit(False)))
    copies = F.col("passes") + once_more.cast("long")
    out = joined(sized, plan, ["source", "size"]).withColumn("copies", copies)
    given = [F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)]
    return out.select("doc_id", "source", *given, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(mix: DataFrame) -> DataFrame:
    """The mixture: each document as often as the mix takes it."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
