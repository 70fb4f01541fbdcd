"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model (Jelinek-Mercer): of a word w after v it says
(1 - k) c(v, w) / c(v) + k (c(w) + 1) / (N + V + 1), where k = WEIGHT * c(v) ** -FALL, and 1 after a word never seen. The
word before a text's first is the end of a text. With exact counts these sum to one over all words and one unseen word.
All counts that the model reads are quantised on a logarithmic scale and kept in a Bloom filter: a key of level q is
entered as (key, 1) ... (key, q), and is read by asking for (key, 1), (key, 2), ... until the answer is no. Levels are
never read too low, and too high by one or more only as often as the filter errs.

1. Tasks take batches of texts, and send the distinct words and bigrams of a batch with their training counts, packed,
   to partitions of the hash space. A word or bigram, however frequent, is one entry of each batch. The texts of the
   batches are sent packed to where they are scored, by a second reading: a table or checkpoint gives the same batches
   again, and an input that does not is an error.
2. In its partition each word's count is known exactly, which is what the base score needs. There the partition's piece
   of the filter is built, with BITS bits for an entry at any corpus size, and asked for the keys of every batch. The
   pieces stay where they are made: a filter that grows with the corpus has no bound under which it may be broadcast.
3. Levels and counts go to the batches, and the texts are scored.

Null and empty texts are one end token. A null doc_id counts as the empty text for the fold. Repeated rows give repeated
results and count as often as they occur; other columns are not looked at; an empty table gives no rows. Words are
known by 64-bit hashes; equal texts of a batch are worked on once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_bucket, mixed, pack_ints, pack_sorted, parts_for, runs, slices, table, unpack_ints, unpack_sorted, words_of

END = b"end of text"  # no word has a blank
SALT = np.uint64(0x5851F42D4C957F2D)
BASE, LEVELS = 1.2, 160
BITS, PROBES = 12, 4
WEIGHT, FALL = 0.85, 0.1
TOKENS_TOGETHER = 2_000_000
#: Bytes of text whose words and bigrams one partition holds.
BYTES_A_PART = 16 << 20
#: Level q stands for counts from STEPS[q - 1] up to STEPS[q], and for WORTH[q].
STEPS = np.unique(np.ceil(BASE ** np.arange(LEVELS)))
WORTH = np.concatenate([[0.0], np.append((STEPS[:-1] + STEPS[1:] - 1) / 2, STEPS[-1])])
#: What tasks send: keys and training counts of words and bigrams; and the texts of a batch. `check` tells batches apart.
SENT = "part long, batch long, check long, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERED = "part long, batch long, check long, n long, v long, counts binary, word_levels binary, pair_levels binary"
TEXTS = "batch long, check long, docs binary, sizes binary, tokens binary, distinct binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def names(schema: str) -> list[str]:
    return schema.replace(",", "").split()[::2]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, side="right")


class Numbers(dict):
    """Numbers words as they come; the end of a text is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, [*words, END]), np.int64, len(words) + 1)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def bigrams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the word before (the end's at the start of a text) and of the word, as one integer."""
    before = np.concatenate([[0], tokens[:-1]])
    before[starts] = 0
    return (before << 32) | tokens


def pair_keys(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mixed(mixed(hashes[pairs >> 32]) + hashes[pairs & 0xFFFFFFFF])


class Filter:
    """A piece of the Bloom filter, for the keys of one partition."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits: int = BITS):
        self.size = np.uint64(max(64, int(levels.sum()) * bits))
        table_ = np.zeros(int(self.size), bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= q], levels[levels >= q]
            for p in self.places(keys, q):
                table_[p] = True
        self.bits = np.packbits(table_, bitorder="little")

    def places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        one = mixed(keys + np.uint64((2 * level * 0xD1342543DE82EF95) % (1 << 64)))
        two = mixed(one) | np.uint64(1)
        for i in range(PROBES):
            yield (one + np.uint64(i) * two) % self.size

    def holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self.places(keys, level):
            found &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Of each key, by asking for one level after the other."""
        level, at, q = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(at) and q < len(WORTH) - 1:
            q += 1
            at = at[self.holds(keys[at], q)]
            level[at] = q
        return level


def probabilities(before: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int, v: int) -> np.ndarray:
    """Of words, from the counts of the word before, the word and the bigram."""
    weight = np.where(before > 0, WEIGHT * np.maximum(before, 1) ** -FALL, 1.0)
    return (1 - weight) * pair / np.maximum(np.maximum(before, pair), 1) + weight * (word + 1) / (n + v + 1)


class Batch:
    """Texts that are worked on together: rows (doc_id, held out, number of the text), and the distinct texts as numbers
    of distinct words."""

    def __init__(self, number: int):
        self.number, self.numbers, self.index, self.texts, self.rows, self.held = number, Numbers(), {}, [], [], 0

    def add(self, doc_id: int | None, text: str | None, held_out: bool) -> None:
        k = self.index.setdefault(text or "", len(self.index))
        self.rows.append((doc_id or 0, doc_id is not None, held_out, k))
        if k == len(self.texts):
            self.texts.append(self.numbers.of(text))
            self.held += len(self.texts[-1])

    def closed(self) -> None:
        self.docs = np.array(self.rows, np.int64).T
        self.sizes = np.array([len(x) for x in self.texts])
        self.tokens = np.concatenate(self.texts)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        self.check = xxhash.xxh3_64_intdigest(self.docs.tobytes() + self.sizes.tobytes() + self.hashes.tobytes()) >> 1

    def keys(self, bounds: np.ndarray) -> Iterator[tuple]:
        """Rows of SENT: sorted hashes of words and of bigrams, with their training counts, by part."""

        def cut(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
            order = np.argsort(keys, kind="stable")
            at = np.searchsorted(keys[order], bounds)
            return [(pack_sorted(k), pack_ints(c)) if len(k) else (None, None) for k, c in zip(np.split(keys[order], at), np.split(counts[order], at), strict=True)]

        _, _, held, at = self.docs
        times = np.repeat(np.bincount(at[held == 0], minlength=len(self.sizes)), self.sizes)
        pairs = bigrams(self.tokens, starts_of(self.sizes))
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = runs(pairs)
        words = cut(self.hashes, np.bincount(self.tokens, times, len(self.hashes)).astype(np.int64))
        for part, (w, p) in enumerate(zip(words, cut(pair_keys(pairs[first], self.hashes), np.add.reduceat(times[order], first)), strict=True)):
            if w[0] or p[0]:
                yield part, self.number, self.check, *w, *p

    def packed(self) -> Iterator[tuple]:
        """The row of TEXTS."""
        yield self.number, self.check, pack_ints(self.docs.ravel(), "<i8"), pack_ints(self.sizes), pack_ints(self.tokens), pack_ints(self.hashes, "<u8")


def sent(docs: DataFrame, rows_of: Callable[[Batch], Iterator[tuple]], schema: str, together: int) -> DataFrame:
    """docs: (doc_id, text, held_out) -> what rows_of tells of each batch of texts."""

    def flush(batch: Batch) -> Iterator[pa.RecordBatch]:
        batch.closed()
        for r in rows_of(batch):  # one by one: a row may be large
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if x is None or isinstance(x, bytes) else pa.int64()) for x in r], names(schema))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = Batch(TaskContext.get().partitionId() << 32)
        for b in slices(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                batch.add(*row)
                if batch.held >= together:
                    yield from flush(batch)
                    batch = Batch(batch.number + 1)
        if batch.rows:
            yield from flush(batch)

    return docs.mapInArrow(send, schema)


def answered(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """To each batch, the counts of its words, and the levels of its words and bigrams as the filter has them; and from
    each partition its training tokens and distinct words."""
    columns = names(ANSWERED)

    def together(blobs: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        each = [unpack_sorted(x) for x in blobs]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        return keys, at, np.bincount(at, np.concatenate([unpack_ints(x) for x in counts]), len(keys)).astype(np.int64), np.cumsum([len(x) for x in each])[:-1]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        w, p = pdf[pdf["words"].notna()], pdf[pdf["pairs"].notna()]
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        words, at_w, c, cut_w = together(w["words"], w["word_counts"]) if len(w) else none
        pairs, at_p, c2, cut_p = together(p["pairs"], p["pair_counts"]) if len(p) else none
        keys = np.concatenate([words ^ SALT, pairs])
        levels = Filter(keys, level_of(np.concatenate([c, c2])), bits).levels(keys)
        of_words, of_pairs = levels[: len(words)][at_w], levels[len(words) :][at_p]
        batches: dict[int, list] = {int(b): [part, int(b), int(c), *(None,) * 5] for b, c in zip(pdf["batch"], pdf["check"], strict=True)}
        for b, x, y in zip(w["batch"], np.split(c[at_w], cut_w), np.split(of_words, cut_w), strict=False):
            batches[int(b)][5:7] = [pack_ints(x, "<i8"), pack_ints(y, "<u1")]
        for b, y in zip(p["batch"], np.split(of_pairs, cut_p), strict=False):
            batches[int(b)][7] = pack_ints(y, "<u1")
        return pd.DataFrame([*batches.values(), [part, -1, 0, int(c.sum()), int((c > 0).sum()), *(None,) * 3]], columns=columns).astype({"n": "Int64", "v": "Int64"})

    return keys.groupBy("part").applyInPandas(meet, ANSWERED)


def batch_scores(texts: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    def joined(blobs: pd.Series, kind: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(unpack_ints(x, kind) for x in blobs.dropna())])

    def score(batch: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")  # as the keys are sorted
        if len(batch) != 1 or not len(pdf) or (pdf["check"] != batch["check"].iloc[0]).any():
            raise ValueError("the documents came in other batches when read again: checkpoint them first")
        own = batch.iloc[0]
        ids, known, held, at = unpack_ints(own["docs"], "<i8").reshape(4, -1)
        sizes, tokens, hashes = unpack_ints(own["sizes"]).astype(np.int64), unpack_ints(own["tokens"]).astype(np.int64), unpack_ints(own["distinct"], "<u8")
        starts, order = starts_of(sizes), np.argsort(hashes, kind="stable")
        exact, level = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        exact[order], level[order] = joined(pdf["counts"], "<i8"), joined(pdf["word_levels"], "<u1")
        pairs, to = np.unique(bigrams(tokens, starts), return_inverse=True)
        pair_level = np.empty(len(pairs), np.int64)
        pair_level[np.argsort(pair_keys(pairs, hashes), kind="stable")] = joined(pdf["pair_levels"], "<u1")
        count = WORTH[level]
        p = np.log10(probabilities(count[pairs >> 32], count[pairs & 0xFFFFFFFF], WORTH[pair_level], n, v))
        base = np.add.reduceat(np.log10(exact + 1.0)[tokens], starts) - sizes * np.log10(n + v + 1.0)
        of_text = {"n_tokens": sizes, "n_known": np.add.reduceat((exact > 0)[tokens].astype(np.int64), starts), "base_score": base, "score": np.add.reduceat(p[to], starts)}
        out = pd.DataFrame({k: x[at] for k, x in of_text.items()})
        return out.assign(doc_id=pd.Series(ids).astype("Int64").where(known > 0), held_out=held > 0, train_tokens=n)[names(SCORED)]

    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, SCORED)


def scored(docs: DataFrame, folds: int = 7, held: int = 2, bits: int = BITS, together: int = TOKENS_TOGETHER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    rows = docs.select("doc_id", "text", (crc_bucket("doc_id", folds) == held).alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = parts_for(docs, BYTES_A_PART)
    bounds = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    answers = checkpointed(answered(sent(rows, lambda batch: batch.keys(bounds), SENT, together), bits))
    total = answers.where("batch = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    texts = sent(rows, lambda batch: batch.packed(), TEXTS, together)
    return batch_scores(texts, answers.where("batch >= 0").drop("n", "v"), total["n"], total["v"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
