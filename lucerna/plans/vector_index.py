"""An index of vectors on disk: coarse cells, searched in the nearest cells or, with a bound on distances, exactly.

Cells are centres of k-means, fitted on at most `SAMPLE` vectors (chosen by a hash of the id); every row is put into the
cell of its nearest centre. The table is partitioned by cell; a cell with many rows has several pieces, so that one search
task sees about `PIECE` rows, however the rows crowd. Questions are joined to the pieces of the cells that they probe, and
both meet in a task: no question and no row goes through the driver, rows of other cells are not read.

An exact search probes the nearest cells first. Then it knows for each question how near the k-th neighbour is, and probes
those other cells whose nearest possible vector (distance of the centre less the cell's radius) is not farther. A search
with a filter that leaves a question nothing is repeated without it for that question. Null vectors and vectors of zeros
are in no cell: they find nothing and are never found. Ids are unique.

`upsert` compares content hashes: new and changed contents get a vector, rows whose other columns changed are written anew
with the vector they have, missing ids go; only the cells that this touches are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import new_path, written

#: Vectors that centres are fitted on, rounds of fitting, most centres.
SAMPLE, ROUNDS, CENTRES = 20_000, 8, 4096
#: Rows in a piece of a cell, and questions that a task has beside them, about.
PIECE, ASKED = 4096, 2048
#: Cells that a search probes first, as a share of all, and at least.
PROBED, FEW = 0.25, 4


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    id_: str
    vector: str
    content: str
    columns: tuple[str, ...]

    def rows(self) -> DataFrame:
        """The rows in their cells. A row without id only keeps a cell's folder."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col(self.id_).isNotNull())

    def cells(self) -> DataFrame:
        """(cell, n, radius): the greatest distance of a row from its centre."""
        return self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("__far").alias("radius"))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length 1, and which rows have one."""
    some = [v for v in column.to_pylist()]
    good = np.array([v is not None and any(v) for v in some], bool)
    x = np.array([v for v, g in zip(some, good, strict=True) if g], np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x), good


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """n centres by k-means, from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=n)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def celled(df: DataFrame, index_of: np.ndarray, vector: str) -> DataFrame:
    """The rows with their cell and distance from its centre; those without a direction go."""
    sent = df.sparkSession.sparkContext.broadcast(index_of)  # CENTRES vectors at most
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names, at = df.columns, df.columns.index(vector)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for b in batches:
            x, good = unit(b.column(at))
            if len(x):
                gap = np.maximum(1 + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0)
                near = gap.argmin(axis=1)
                far = np.sqrt(gap[np.arange(len(x)), near])
                kept = b.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*names, "cell", "__far"])

    return df.mapInArrow(place, f"{fields}, cell int, __far double")


def pieced(rows: DataFrame) -> DataFrame:
    """With the piece of its cell that each row is in."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("__pieces"))
    return rows.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("__id"), F.col("__pieces")).cast("int")).drop("__pieces")


def build(df: DataFrame, id_: str, vector: str, content: str, path: str | None = None) -> VectorIndex:
    """All columns are kept, for filters; `content` is a hash of what the vector stands for."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, "vectors")
    has = df.where(F.col(vector).isNotNull())
    sample = has.select(vector).orderBy(F.xxhash64(id_), id_).limit(SAMPLE).toArrow().column(0)  # SAMPLE vectors
    x, _ = unit(sample)
    n = int(min(CENTRES, max(1, round(np.sqrt(has.count()))), max(1, len(x))))
    centres = fitted(x, n) if len(x) else np.zeros((1, 1))
    index = VectorIndex(spark, path, centres, id_, vector, content, tuple(df.columns))
    stored(index, celled(df, centres, vector))
    return index


def stored(index: VectorIndex, rows: DataFrame) -> None:
    """Writes the cells that the rows are in, in place of what they held."""
    rows = pieced(rows.withColumn("__id", F.col(index.id_))).drop("__id")
    rows.repartition("cell", "piece").write.partitionBy("cell").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{index.path}/rows")


def nearest_cells(index: VectorIndex, asked: DataFrame, query: str, vector: str) -> DataFrame:
    """(query, vector, cells, gaps): all centres, nearest first, and how far."""
    sent = index.spark.sparkContext.broadcast(index.centres)
    kind = asked.schema[query].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x, good = unit(part.column(1))
                if len(x):
                    gap = np.sqrt(np.maximum(1 + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0))
                    order = np.argsort(gap, axis=1, kind="stable").astype(np.int32)
                    lists = [pa.array(list(v)) for v in (x, order, np.take_along_axis(gap, order, axis=1))]
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), *lists], [query, "__v", "__cells", "__gaps"])

    return asked.select(query, vector).mapInArrow(near, f"`{query}` {kind}, __v array<double>, __cells array<int>, __gaps array<double>")


def probe(index: VectorIndex, probes: DataFrame, query: str, k: int, where: Column | None) -> DataFrame:
    """probes (query, __v, cell) -> the k best rows of each question in those cells, with their score."""
    rows = index.rows() if where is None else index.rows().where(where)
    sizes = index.rows().groupBy("cell", "piece").agg(F.count("*").alias("__n")).select("cell", "piece")
    crowds = probes.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("__crowds"))
    salted = probes.join(crowds, "cell").withColumn("__crowd", F.pmod(F.xxhash64(query), F.col("__crowds")).cast("int"))
    asked = salted.join(sizes, "cell").select("cell", "piece", "__crowd", F.col(query).alias("__q"), "__v")
    met = rows.select("cell", "piece", F.col(index.id_).alias("__i"), F.col(index.vector).alias("__x")).join(crowds, "cell")
    met = met.select("cell", "piece", F.explode(F.sequence(F.lit(0), F.col("__crowds") - 1)).alias("__crowd"), "__i", "__x")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((probes, query), (index.rows(), index.id_))]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x, good = unit(left.column("__x").combine_chunks())
        found, asked, own = [], right.column("__q").to_pylist(), left.column("__i").filter(pa.array(good)).to_pylist()
        if asked and own:
            s = np.round(np.array(right.column("__v").to_pylist()) @ x.T, 9)
            few = min(k, len(own))
            edge = -np.partition(-s, few - 1, axis=1)[:, few - 1, None]
            i, j = np.nonzero(s >= edge)
            found = [[asked[a] for a in i], [own[b] for b in j], s[i, j]]
        return pa.table(dict(zip(out.names, found or [[], [], []], strict=True)), schema=out)

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([(query, types[kinds[0]]), (index.id_, types[kinds[1]]), ("score", pa.float64())])
    keys = ["cell", "piece", "__crowd"]
    hits = met.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, f"`{query}` {kinds[0]}, `{index.id_}` {kinds[1]}, score double")
    w = Window.partitionBy(query).orderBy(F.desc("score"), index.id_)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search(index: VectorIndex, asked: DataFrame, query: str, vector: str, k: int, where: Column | None = None, exact: bool = False, probes: int | None = None) -> DataFrame:
    """(query, id, score, place, filtered): the k nearest rows of each question by cosine; `filtered` is false where the
    filter left a question nothing and it was asked again without."""
    near = written(nearest_cells(index, asked, query, vector))
    found = written(found_in(index, near, query, k, where, exact, probes))
    out = found.withColumn("filtered", F.lit(where is not None))
    if where is None:
        return out
    again = near.join(found.select(query).distinct(), query, "left_anti")
    if not again.limit(1).count():
        return out
    return out.union(found_in(index, again, query, k, None, exact, probes).withColumn("filtered", F.lit(False)))


def found_in(index: VectorIndex, near: DataFrame, query: str, k: int, where: Column | None, exact: bool, probes: int | None) -> DataFrame:
    n = probes or max(FEW, int(np.ceil(PROBED * len(index.centres))))
    first = near.select(query, "__v", F.explode(F.slice("__cells", 1, n)).alias("cell"))
    found = probe(index, first, query, k, where)
    if not exact:
        return found
    found = written(found)
    edge = found.where(F.col("place") == k).select(query, F.sqrt(F.lit(2.0) - 2 * F.col("score")).alias("__edge"))
    others = near.select(query, "__v", F.posexplode(F.arrays_zip("__cells", "__gaps")).alias("at", "c")).where(F.col("at") >= n).select(query, "__v", F.col("c.__cells").alias("cell"), F.col("c.__gaps").alias("__gap"))
    more = others.join(F.broadcast(index.cells()), "cell").join(edge, query, "left")
    more = more.where(F.col("__edge").isNull() | (F.col("__gap") - F.col("radius") <= F.col("__edge") + 1e-6)).select(query, "__v", "cell")
    both = found.drop("place").union(probe(index, more, query, k, where).drop("place"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), index.id_)
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def upsert(index: VectorIndex, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], whole: bool = True) -> dict[str, int]:
    """Brings the index to the state of `rows` (all columns but the vector), or adds them (whole=False). `embed` adds the
    vector to the rows it is given: those whose content is new. -> how many rows were embedded, rewritten, kept, removed."""
    old = index.rows()
    others = [c for c in index.columns if c not in (index.vector,)]
    state = rows.select(*others)
    was = old.select(F.col(index.id_).alias("__was"), F.col(index.content).alias("__content"), F.struct(*(c for c in others if c != index.id_)).alias("__old"), F.col(index.vector).alias("__vector"))
    both = written(state.join(was, F.col(index.id_) == F.col("__was"), "full"))
    fresh = both.where(F.col(index.id_).isNotNull() & ((F.col("__was").isNull()) | ~F.col(index.content).eqNullSafe(F.col("__content"))))
    same = both.where(F.col("__was").isNotNull() & F.col(index.id_).isNotNull() & F.col(index.content).eqNullSafe(F.col("__content")))
    changed = same.where(~F.struct(*(F.col(c) for c in others if c != index.id_)).eqNullSafe(F.col("__old")))
    gone = both.where(F.col(index.id_).isNull()).select("__was") if whole else both.limit(0).select("__was")
    vectors = written(embed(fresh.select(*others)).select(*index.columns))
    new = celled(vectors.unionByName(changed.select(*others, F.col("__vector").alias(index.vector)).select(*index.columns)), index.centres, index.vector)
    new = written(new)
    replaced = new.select(index.id_).union(gone).union(fresh.where("__was is not null").select("__was")).distinct()
    touched = old.join(replaced, index.id_, "left_semi").select("cell").union(new.select("cell")).distinct()
    kept = old.join(F.broadcast(touched), "cell", "left_semi").join(replaced, index.id_, "left_anti").select(*index.columns, "cell", "__far")
    holders = touched.select(*(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in index.columns), "cell", F.lit(0.0).alias("__far"))
    stored(index, written(kept.unionByName(new.select(*kept.columns)).unionByName(holders)))
    return {"embedded": vectors.count(), "rewritten": changed.count(), "kept": same.count() - changed.count(), "removed": gone.count()}
