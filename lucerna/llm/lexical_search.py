"""Ranked lexical search with blocked posting lists: the k documents of greatest score for each item, exactly.

Terms are runs of ASCII letters, digits and anything beyond ASCII, A-Z lowered. With N documents that have terms, L terms in
all, n terms in a document and df documents with a term, a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document's
m is 75 + 25 n N div L, and its score the sum of w * (10^9 tf div (1000 tf + 12 m)) over an item's terms, repeats included.

Items go out in blocks of bounded size. For each block one pass over the texts counts df, N and L, and a second one searches:
every task cuts its documents into shards and indexes the terms that the block asks for. A posting list of a shard is
clustered: documents go to the most similar of some sampled ones (cosine of a random projection of their weighted vectors),
and each cluster is a block with the coordinatewise maximum of its documents' vectors. Terms are ordered from heavy to
light. A document is due in the list of its heaviest term that the item has, so that the summary of a block holds only the
coordinates from its own term on, and the longest lists have the shortest summaries. A block is skipped only if the item's
weights on its summary stay below the score of the item's k-th document so far: then no document that is due there can get
in. All else is scored in whole numbers. Every task keeps k documents for each item over all its shards; they meet in two
steps, by salts and then by item.

No document is shuffled and no list meets in one task, however common its term. Equal scores: ascending doc_id, null last.
Null and empty texts have no terms and are found by none; repeated rows and ids are documents of their own, and so each row
of items is an item of its own. Items without terms, empty tables and scores of 0 give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

#: Items, and distinct terms of items, that go out at a time (an item with more terms goes alone).
ITEMS, TERMS = 512, 16_384
#: Numbers in a shard's table of documents and terms, and documents in a shard, at most.
CELLS, ROWS = 1 << 23, 8192
#: Documents in a block, about; a list of few documents has no summaries and is scored.
BLOCK, SHORT = 48, 16
#: Numbers of a document's projection.
WIDTH = 24
SALTS = 256
#: What a byte becomes: the marks below 0x80 that are no letters or digits part terms.
FOLDED = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256))
FOUND = "item long, item_id long, doc_id long, score long, salt int"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """(number, item_id, terms) of the items, in blocks; only one block at a time is on the driver."""
    block, terms = [], set()
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        own = Counter(terms_of(row["text"]))
        if block and (len(block) == ITEMS or len(terms | own.keys()) > TERMS):
            yield block
            block, terms = [], set()
        block.append((number, row["item_id"], own))
        terms |= own.keys()
    if block:
        yield block


def texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[int | None, list[bytes]]]:
    """(id, terms) of the rows, few texts at a time as Python values."""
    for b in slices(batches, 64):
        ids = b.column(0).to_pylist() if column else [None] * b.num_rows
        yield from zip(ids, map(terms_of, b.column(column).to_pylist()), strict=True)


def statistics(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(N, L, df of these terms), over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # a block's terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, df, rows, total = sent.value, np.zeros(len(sent.value), np.int64), 0, 0
        for _, words in texts(batches, 0):
            rows += bool(words)
            total += len(words)
            for t in place.keys() & set(words):
                df[place[t]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([rows, total, *df[at].tolist()])], ["term", "n"])

    out = np.zeros(len(terms) + 2, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        out[r["term"]] = r["n"]
    sent.unpersist()
    return int(out[-2]), int(out[-1]), out[:-2]


class Shard:
    """Documents in memory, and the clustered posting lists of their terms. Columns are terms from heavy to light, lists[j]
    the documents with term j, block by block, summaries[j] a row for each of its blocks with the columns from j on."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_docs: int, weights: np.ndarray, seed: int = 1):
        present, local = np.unique(columns, return_inverse=True)
        self.present = present
        self.x = np.zeros((n_docs, len(present)), np.int32)
        self.x[rows, local] = impacts
        dice = np.random.default_rng(seed)
        heavy = (weights[present] / 1e9).astype(np.float32)[:, None] * dice.standard_normal((len(present), WIDTH)).astype(np.float32)
        z = np.empty((n_docs, WIDTH), np.float32)
        for i in range(0, n_docs, 256):
            z[i : i + 256] = self.x[i : i + 256].astype(np.float32) @ heavy
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-20)
        by_term = np.lexsort((rows, local))
        cuts = np.searchsorted(local[by_term], np.arange(len(present) + 1))
        self.lists, self.starts, self.summaries = [], [], []
        for j in range(len(present)):
            docs = rows[by_term[cuts[j] : cuts[j + 1]]]
            starts = np.zeros(1, np.int64)
            if len(docs) > SHORT:
                docs, starts = clustered(docs, z, dice)
            self.lists.append(docs)
            self.starts.append(np.append(starts, len(docs)))
            self.summaries.append(np.maximum.reduceat(self.x[docs, j:], starts, axis=0) if len(docs) > SHORT else None)
        self.top = self.x.max(axis=0, initial=0).astype(np.int64)
        self.scored_blocks = self.skipped_blocks = 0

    def search(self, columns: np.ndarray, weights: np.ndarray, least: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The item's columns, ascending, with its weights, and the score that counts -> (documents, scores). What `send`
        gives is the score that counts from then on."""
        at = np.searchsorted(self.present, columns)
        at[at == len(self.present)] = 0
        here = self.present[at] == columns if len(self.present) else np.zeros(len(columns), bool)
        columns, weights = at[here], weights[here]
        left = np.cumsum((self.top[columns] * weights)[::-1])[::-1]
        seen = np.zeros(len(self.x), bool)
        for p, j in enumerate(columns):
            if left[p] < least:  # no summary of this list or a lighter one can reach it
                self.skipped_blocks += sum(len(self.starts[i]) - 1 for i in columns[p:])
                break
            ends = self.starts[j]
            blocks = np.arange(len(ends) - 1)
            if self.summaries[j] is not None:
                bound = self.summaries[j][:, columns[p:] - j].astype(np.int64) @ weights[p:]
                blocks = np.argsort(-bound, kind="stable")
                blocks = blocks[bound[blocks] >= least]
                # The best blocks come first, so that fewer of the others are left.
                rounds = [blocks[:2], blocks[2:8], blocks[8:]]
            else:
                bound, rounds = None, [blocks]
            done = 0
            for some in rounds:
                if bound is not None:
                    some = some[bound[some] >= least]
                if not len(some):
                    continue
                done += len(some)
                docs = np.concatenate([self.lists[j][ends[b] : ends[b + 1]] for b in some])
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    score = self.x[docs[:, None], columns].astype(np.int64) @ weights
                    good = score >= least
                    least = max(least, (yield docs[good], score[good]) or least)
            self.scored_blocks += done
            self.skipped_blocks += len(ends) - 1 - done


def clustered(docs: np.ndarray, z: np.ndarray, dice: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The documents by cluster, and where blocks start: each goes to the nearest of some sampled ones; a large cluster
    (copies) is cut into blocks."""
    centres = z[dice.choice(docs, -(-len(docs) // BLOCK), replace=False)]
    near = (z[docs] @ centres.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    near, place = near[order], np.arange(len(docs))
    new = np.append(True, near[1:] != near[:-1])
    first = np.maximum.accumulate(np.where(new, place, 0))
    return docs[order], np.flatnonzero(new | ((place - first) % (4 * BLOCK) == 0))


class Best:
    """The k best documents of an item so far, as (-score, no id, id)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list, scores: np.ndarray) -> int:
        self.rows = sorted([*self.rows, *((-int(s), i is None, i or 0) for i, s in zip(ids, scores, strict=True))])[: self.k]
        return self.least


class Searcher:
    """Documents in, shard by shard; the best of each item out."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], place: dict[bytes, int], weights: np.ndarray, n: int, total: int, k: int):
        self.items, self.place, self.weights, self.n, self.total, self.k = items, place, weights, n, total, k
        self.best = [Best(k) for _ in items]
        self.most = min(ROWS, max(64, CELLS // max(1, len(place))))
        self.blocks = [0, 0]
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows, self.columns, self.tf, self.m = [], [], [], [], []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        found = [(c, n) for t, n in Counter(words).items() if (c := self.place.get(t)) is not None]
        if not found:
            return
        m = 75 + 25 * len(words) * self.n // self.total
        row = len(self.ids)
        self.ids.append(doc_id)
        self.rows += [row] * len(found)
        self.m += [m] * len(found)
        self.columns += [c for c, _ in found]
        self.tf += [n for _, n in found]
        if len(self.ids) >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        tf, m = np.array(self.tf, np.int64), np.array(self.m, np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        shard = Shard(np.array(self.rows), np.array(self.columns), impacts, len(self.ids), self.weights)
        for (columns, weights), best in zip(self.items, self.best, strict=True):
            search, found = shard.search(columns, weights, best.least, self.k), None
            try:
                while True:
                    docs, scores = search.send(found)
                    found = best.add([self.ids[d] for d in docs], scores)
            except StopIteration:
                pass
        self.blocks = [self.blocks[0] + shard.scored_blocks, self.blocks[1] + shard.skipped_blocks]
        self.clear()


def searched(docs: DataFrame, block: list[tuple[int, int | None, Counter]], k: int) -> DataFrame:
    """One block of items -> the k best documents of each in every task."""
    terms = sorted(set().union(*(own for _, _, own in block)))
    n, total, df = statistics(docs, terms)
    weights = np.array([weight(n, int(d)) for d in df], np.int64)
    order = [int(i) for i in np.lexsort((np.arange(len(terms)), -weights)) if df[i] and weights[i]]
    place = {terms[i]: c for c, i in enumerate(order)}
    heavy, items = weights[order], []
    for _, _, own in block:
        at = sorted((place[t], c) for t, c in own.items() if t in place)
        columns = np.array([c for c, _ in at], np.int64)
        items.append((columns, heavy[columns] * np.array([c for _, c in at], np.int64)))
    sent = docs.sparkSession.sparkContext.broadcast(([(number, id_) for number, id_, _ in block], items, place, heavy))  # a block of items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, place, heavy = sent.value
        run = Searcher(items, place, heavy, n, total, k)
        for doc_id, words in texts(batches, 1):
            run.add(doc_id, words)
        run.flush()
        salt = TaskContext.get().partitionId() % SALTS
        for (number, id_), best in zip(ids, run.best, strict=True):
            if best.rows:
                rows = [(number, id_, None if none else doc, -s, salt) for s, none, doc in best.rows]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (item_id, rank, doc_id, score)."""
    out = None
    for block in item_blocks(items):
        found = searched(docs, block, k)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], FOUND)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "salt"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sized AS (SELECT row_number() OVER () AS row, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
postings AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, n_docs),
items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
asked AS (SELECT item, item_id, term, count(*)::BIGINT AS c FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT item, item_id, row, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
