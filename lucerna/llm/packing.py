"""Vector best-fit packing of token sequences.

A piece's size is a vector: its tokens, one document, and its attention cost (length squared). A bin has a capacity in
each. Pieces of one length are alike, so the plan is made for lengths: the histogram of lengths, at most `capacity`
rows however large the corpus, goes to the driver, which fills bins longest pieces first. Of the bins in which a piece
fits under every constraint, the rule takes the one with the least weighted residual norm, or the greatest weighted dot
product of piece and residual. Bins with one content form a group (first bin, number), so the work depends on the
lengths, not on the number of pieces. The plan is a list of rank ranges by length; a piece finds its place by its rank
among the pieces of its length, which windows over salted lengths number in parallel.

Null and empty texts are one end token. Texts are cut only if longer than the capacity; the first piece may be shorter.
Repeated rows are packed as often as they occur; ties are broken by doc_id (null first), piece and checksum. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_parts, slices, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Pieces of one length that one task numbers at least; beyond that, a quarter of a shuffle partition's share.
RANKED_TOGETHER = 2_000


def load_encoder(vocabulary: str, end: int):
    """A byte-level BPE from its ranks; the end token's string in a text is that token, as the tokenizer's file has it."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end})


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: whole if it fits, else a shorter one first and full ones after it."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, s + capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", special: int = 50256, end: int = 2, capacity: int = 1024) -> DataFrame:

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(vocabulary, special)
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
                rows += [(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, pieces a bin, offset in the bin), by first rank."""
    caps = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    bins: list[list[int]] = []  # [first bin, number of bins, tokens, documents, cost left]
    left = np.empty((0, 3))
    out: dict[int, list] = {}
    n_bins = 0
    for length in sorted(counts, reverse=True):
        item, rank, todo = np.array([length, 1, length * length], float), 0, counts[length]
        rows = out.setdefault(length, [])
        while todo:
            fits = np.flatnonzero((left >= item).all(1))
            if not len(fits):
                per = int(min(caps // item))
                if not per:
                    raise ValueError(f"a piece of {length} tokens fits in no bin")
                bins.append([n_bins, -(-todo // per)])
                n_bins += bins[-1][1]
                left = np.vstack([left, caps])
                best = len(bins) - 1
            elif rule == "dot":
                best = fits[np.argmax((left[fits] / caps * (item / caps) * w).sum(1))]
            else:
                best = fits[np.argmin((((left[fits] - item) / caps) ** 2 * w).sum(1))]
            first, number = bins[best]
            per = min(int(min(left[best] // item)), todo)
            full = min(number, todo // per)
            rows.append((rank, first, per, int(capacity - left[best][0])))
            if full < number:  # the other bins of the group stay as they are
                bins.append([first + full, number - full])
                left = np.vstack([left, left[best]])
            bins[best] = [first, full]
            left[best] -= item * per
            rank, todo = rank + full * per, todo - full * per
        keep = left[:, 0] > 0
        if not keep.all():
            bins, left = [b for b, k in zip(bins, keep, strict=True) if k], left[keep]
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """Pieces with the sequence and the offset at which each stands. Unless they are given, the capacities for documents
    and attention cost are those of a sequence of `capacity` one-token documents and of one document: they cost no
    sequence, and act by the residuals that choose between bins."""
    spark = pieces.sparkSession
    pieces = checkpointed(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, rule))
    most = max(RANKED_TOGETHER, sum(counts.values()) // (4 * shuffle_parts(spark)))  # so few salts in all: their sizes go to the driver
    salts = {k: -(-n // most) for k, n in counts.items() if n > most}
    salted = F.lit(0)
    for length, n in salts.items():
        salted = F.when(F.col("length") == length, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")).otherwise(salted)
    rows = pieces.withColumn("salt", salted)
    before = {k: [0] * n for k, n in salts.items()}
    if salts:
        for r in rows.where(F.col("length").isin(*salts)).groupBy("length", "salt").agg(F.count("*").alias("n")).collect():
            before[r["length"]][r["salt"]] = r["n"]
    before = {k: np.concatenate([[0], np.cumsum(v)[:-1]]) for k, v in before.items()}
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    rows = rows.withColumn("rank", F.row_number().over(place) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lengths, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = b.column("rank").to_numpy().astype(np.int64)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                r = rank[at] + (before[length][salt[at]] if length in before else 0)
                ranges = placed.value[length]
                first, base, per, used = ranges[np.searchsorted(ranges[:, 0], r, side="right") - 1].T
                sequence[at], offset[at] = base + (r - first) // per, used + (r - first) % per * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.select(*names, "salt", "rank").mapInArrow(find, PLACED)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces_of(docs))
