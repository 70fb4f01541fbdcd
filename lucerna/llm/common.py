"""What the corpus operators share: reading tables, cutting lineage, hashing words, packing integers for a shuffle."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of an Arrow batch that are worked on at a time: texts may be long, so few of them.
ROWS_A_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_A_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2 * ROWS_A_BATCH) -> Iterator[None]:
    """While a step runs that is worked out at once, Arrow batches have few rows; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or by setCheckpointDir; a folder of its own only in local mode, where
    driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder of spark.checkpoint.dir, read back: unlike a checkpoint's, its size
    estimate is the files' own, so that steps of a loop don't multiply the estimates of those before them."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, bytes_a_part: int) -> int:
    """Partitions of a hash space for all that the texts hold: so many that each has a bounded share of their bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * shuffle_parts(docs.sparkSession), -(-size // bytes_a_part))


def crc_bucket(column: str, mod: int):
    """crc32 of the column as text (null: the empty text), modulo mod."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes.lower() lowers A-Z alone, bytes.split() splits at space and tab to carriage return alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before; the store has a bound and starts anew when full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers, one to one."""
    values = (values ^ (values >> np.uint64(31))) * MIX
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def pack_sorted(values: np.ndarray) -> bytes:
    """Differences of sorted 64-bit integers, byte planes one after the other, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zlib.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(values: np.ndarray, kind: str = "<u4") -> bytes:
    width = np.dtype(kind).itemsize
    return zlib.compress(np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_ints(blob: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, component): the smallest node that links reach.

    Each round every node hooks to its smallest neighbour, hooks are followed to their ends by doubling, and the graph
    is contracted to those ends. A node with links is never an end together with its neighbours, so at least half of the
    nodes go in a round, and the smallest node of a component stays to the last. Each step is a written table: only
    rows move, no component is gathered anywhere, and plans and their size estimates start anew from files. Null ends
    and empty input give no rows; repeated pairs do no harm.
    """
    edges = written(edges.where("a is not null and b is not null and a <> b").select("a", "b"))
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        moved = True
        while moved:
            for last in (False, True):
                ahead = F.col("next") if not last else F.struct("next", (F.col("next") != F.col("to")).alias("moved"))
                hook = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", ahead.alias("to"))
            step = written(hook.select("node", F.col("to.next").alias("to"), F.col("to.moved").alias("moved")))
            moved, hook = bool(step.where("moved").limit(1).count()), step.drop("moved")
        labels = hook if labels is None else written(followed(labels, hook))
        a, b = hook.select(F.col("node").alias("a"), F.col("to").alias("x")), hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels.select("node", F.col("to").alias("component"))


def followed(labels: DataFrame, hook: DataFrame) -> DataFrame:
    """(node, to), with `to` replaced by what it hooks to."""
    on = hook.select(F.col("node").alias("was"), F.col("to").alias("now"))
    return labels.withColumnRenamed("to", "was").join(on, "was", "left").select("node", F.coalesce("now", "was").alias("to"))


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels (node, component) so far, with further links: only the components are linked anew."""
    if labels is None:
        return components(edges)
    at = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).where("a <> b").distinct()
    new = components(between)
    old = followed(labels.withColumnRenamed("component", "to"), new.withColumnRenamed("component", "to")).withColumnRenamed("to", "component")
    return written(old.union(new.join(labels, "node", "left_anti").select("node", "component")))
