"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

Inputs of a word: an embedding of the word and the mean of embeddings of its character 3-grams, both by hashing; and how
much more often the word, and the strongest of its character 5-grams and 7-grams, stand in toxic training documents than
in others (log-odds). Training documents take these odds from other training documents, by folds, so that the network
learns how far odds hold for texts that they were not taken from. An unknown word is still seen by its characters.

A text is cut into overlapping windows of WINDOW words, STRIDE apart; a window's logit is read from the
attention-weighted states of both directions, and the text has its largest window's logit, scaled so that 0.5 divides best.

Training reads a bounded sample of labelled documents outside the held-out fold: PER_CLASS of each class, in the order
of a hash of doc_id; of several rows with one doc_id the least text counts. Labels belong to documents, so each pass
trains a positive document's most suspicious window (at first the one of greatest odds) and of a negative document the
WINDOWS_A_DOC most suspicious. A part of the sample is set aside, and the pass that orders it best is kept.

Scoring covers all windows of all texts. Null and empty texts are one empty window and get the score of no words. Labels
null, or without document, are not used; with no labels of a class all scores are those of the untrained network.
Repeated rows give repeated results; a null doc_id counts as the empty text for the fold; other columns are not looked
at. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, slices, table

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, STATE = 1 << 13, 1 << 12, 12, 8
PER_CLASS, WINDOWS_A_DOC, PASSES = 1500, 8, 8
#: Characters of the grams that have odds, folds of the training sample, the least documents of each class set aside.
GRAMS, FOLDS, ASIDE = (5, 7), 4, 5
ODDS = 1 + len(GRAMS)
#: Share of words whose own embedding training leaves out, so that it can't learn the sample by heart.
DROPPED = 0.5
WORDS = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def stepped(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (h ^ x) * np.uint64(0x9E3779B97F4A7C15)


class Inputs:
    """Distinct words of some texts, apart for each fold: bucket and key of the word, buckets of its character 3-grams,
    keys of its longer grams; and the texts as numbers of words."""

    def __init__(self, texts: list[str | None], fold: np.ndarray | None = None):
        index: dict[tuple[str, int], int] = {}
        folds = [0] * len(texts) if fold is None else fold.tolist()
        self.texts = [np.array([index.setdefault((w, k), len(index)) for w in WORDS.findall((t or "").lower())], np.int64) for t, k in zip(texts, folds, strict=True)]
        self.fold = np.array([k for _, k in index], np.int64)
        code = np.frombuffer("".join(f"^{w}$" for w, _ in index).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w, _ in index], np.int64)
        start = np.cumsum(size) - size
        self.n_grams, self.odds = np.maximum(size - 2, 1), np.zeros((len(index), ODDS), np.float32)
        if not len(code):
            self.grams = self.first = self.words = np.zeros(0, np.int64)
            self.keys, self.long = np.zeros(0, np.uint64), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(GRAMS)
            return
        self.grams = (self.of_size(code, size, 3)[0] >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS
        self.first = np.cumsum(size - 2) - (size - 2)
        self.long = [self.of_size(code, size, n) for n in GRAMS]
        weight = (code * np.uint64(0xBF58476D1CE4E5B9)) * (np.arange(len(code), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64) + np.uint64(1))
        self.keys = np.add.reduceat(stepped(weight, weight >> np.uint64(29)), start)
        self.words = (self.keys >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS

    @staticmethod
    def of_size(code: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word of each gram of n characters within a word and its two ends."""
        count = max(0, len(code) - n + 1)
        h = np.full(count, n, np.uint64)
        for j in range(n):
            h = stepped(h, code[j : j + count])
        owner = np.repeat(np.arange(len(size)), size)
        inside = owner[:count] == owner[n - 1 : n - 1 + count]
        return h[inside], owner[:count][inside]

    def with_odds(self, tables: list[Odds]) -> Inputs:
        """tables: the odds for each fold."""
        for k, table_ in enumerate(tables):
            own = self.fold == k
            self.odds[own, 0] = table_.of(self.keys[own])
            for j, (keys, owner) in enumerate(self.long, 1):
                at = own[owner]
                most = np.full(len(self.fold), -9.0)
                np.maximum.at(most, owner[at], table_.of(keys[at]))
                self.odds[own, j] = np.where(most[own] > -9, most[own], self.odds[own, 0])
        return self

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (-1: none) and the text of each window."""
        rows, owner = [], []
        for k, t in enumerate(self.texts):
            n = max(1, -(-(len(t) - WINDOW) // STRIDE) + 1)
            padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
            padded[: len(t)] = t
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
            owner.append(np.full(n, k))
        return np.concatenate(rows), np.concatenate(owner)


class Odds:
    """Log-odds of keys (words, grams) by the documents of each class that hold them; of other keys 0."""

    def __init__(self, x: Inputs, labels: np.ndarray, docs: np.ndarray):
        held, of_doc = [], []
        for k in np.flatnonzero(docs):
            words = np.unique(x.texts[k])
            held.append(words)
            of_doc.append(np.full(len(words), k))
        words, doc = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (held, of_doc))
        of1, of0 = max(1, (labels[docs] == 1).sum()), max(1, (labels[docs] == 0).sum())
        few1, few0 = 2 * of1 / (of1 + of0), 2 * of0 / (of1 + of0)

        def valued(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(keys, return_inverse=True)
            pair = np.unique(at * len(labels) + doc)
            at, toxic = pair // max(1, len(labels)), labels[pair % max(1, len(labels))] == 1
            n1, n0 = np.bincount(at[toxic], minlength=len(keys)), np.bincount(at[~toxic], minlength=len(keys))
            value = np.log((n1 + few1) / of1) - np.log((n0 + few0) / of0)
            known = n1 + n0 > 1
            return keys[known], np.clip(value[known] / 4, -1.5, 1.5).astype(np.float32)

        each = [valued(x.keys[words], doc)]
        for keys, owner in x.long:
            first = np.searchsorted(owner, np.arange(len(x.keys) + 1))
            n = np.diff(first)[words]
            each.append(valued(keys[np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(doc, n)))
        keys, value = (np.concatenate(v) for v in zip(*each, strict=True))
        order = np.argsort(keys)
        self.keys, self.value = keys[order], value[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.value[at], np.float32(0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"word": r.normal(0, 0.1, (WORD_BUCKETS, WIDTH)), "gram": r.normal(0, 0.3, (GRAM_BUCKETS, WIDTH))}
    for d in "fb":
        p |= {f"W{d}": r.normal(0, 0.3, (2 * WIDTH + ODDS, 3 * STATE)), f"U{d}": r.normal(0, 0.3, (STATE, 3 * STATE)), f"c{d}": np.zeros(3 * STATE)}
    p |= {"A": r.normal(0, 0.3, (2 * STATE, STATE)), "a": r.normal(0, 0.3, STATE), "o": r.normal(0, 0.3, 2 * STATE), "z": np.zeros(1), "scale": np.array([1.0, 0.0])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def embedded(p: dict, x: Inputs) -> np.ndarray:
    """A row for each distinct word: its own embedding, the mean of its 3-grams', its odds. The last row stands for no word."""
    if not len(x.words):
        return np.zeros((1, 2 * WIDTH + ODDS), np.float32)
    grams = np.add.reduceat(p["gram"][x.grams], x.first, axis=0) / x.n_grams[:, None]
    return np.vstack([np.hstack([p["word"][x.words], grams, x.odds]), np.zeros((1, 2 * WIDTH + ODDS))]).astype(np.float32)


def recurrent(proj: np.ndarray, idx: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States (window, step, state). proj: input projections of the distinct words; padding keeps the state."""
    h = np.zeros((len(idx), STATE), np.float32)
    out = np.empty((len(idx), idx.shape[1], STATE), np.float32)
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * STATE]), np.ascontiguousarray(u[:, 2 * STATE :])
    for t in range(idx.shape[1]):
        x = proj[idx[:, t]]
        g = x[:, : 2 * STATE] + h @ u_gates
        np.negative(g, out=g)
        np.exp(np.clip(g, -30, 30, out=g), out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :STATE], g[:, STATE:]
        rh = r * h
        n = np.tanh(x[:, 2 * STATE :] + rh @ u_new)
        new = np.where(mask[:, t, None], n + z * (h - n), h)
        if keep is not None:
            keep.append((h, z, r, n))
        out[:, t] = h = new
    return out


def forward(p: dict, e: np.ndarray, idx: np.ndarray, keep: bool = False):
    """Logit of each window."""
    mask = idx >= 0
    tape_f, tape_b = ([], []) if keep else (None, None)
    hf = recurrent(e @ p["Wf"] + p["cf"], idx, mask, p["Uf"], tape_f)
    hb = recurrent(e @ p["Wb"] + p["cb"], idx[:, ::-1], mask[:, ::-1], p["Ub"], tape_b)[:, ::-1]
    h = np.concatenate([hf, hb], 2)
    t = np.tanh(h @ p["A"])
    s = np.where(mask, t @ p["a"], -1e9)
    w = np.exp(s - s.max(1, keepdims=True)) * mask
    w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
    pooled = (w[:, :, None] * h).sum(1)
    logit = pooled @ p["o"] + p["z"][0]
    return (logit, (mask, tape_f, tape_b, h, t, w, pooled)) if keep else logit


def window_logits(p: dict, e: np.ndarray, idx: np.ndarray, together: int = 2048) -> np.ndarray:
    """Logits of many windows, some at a time: states of all at once would fill the driver's memory."""
    return np.concatenate([forward(p, e, idx[i : i + together]) for i in range(0, len(idx), together)])


def gradients(p: dict, x: Inputs, e: np.ndarray, idx: np.ndarray, d_logit: np.ndarray, kept: tuple, used: np.ndarray | None = None) -> dict[str, np.ndarray]:
    mask, tape_f, tape_b, h, t, w, pooled = kept
    g = {"o": pooled.T @ d_logit, "z": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * p["o"]
    dw = (h * d_pool[:, None]).sum(2)
    ds = w * (dw - (w * dw).sum(1, keepdims=True))
    g["a"] = np.einsum("ij,ijk->k", ds, t)
    dt = ds[:, :, None] * p["a"] * (1 - t * t)
    g["A"] = np.einsum("ijk,ijl->kl", h, dt)
    dh = w[:, :, None] * d_pool[:, None] + dt @ p["A"].T
    de = np.zeros_like(e)
    for d, tape, own, place, shown in (("f", tape_f, dh[:, :, :STATE], idx, mask), ("b", tape_b, dh[:, ::-1, STATE:], idx[:, ::-1], mask[:, ::-1])):
        u, gu = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
        back, d_proj = np.zeros((len(idx), STATE), np.float32), np.zeros((len(e), 3 * STATE), np.float32)
        for k in range(idx.shape[1] - 1, -1, -1):
            before, z, r, n = tape[k]
            total = own[:, k] + back
            m = shown[:, k, None]
            dn = total * (1 - z) * (1 - n * n) * m
            dz = total * (before - n) * z * (1 - z) * m
            d_rh = dn @ u[:, 2 * STATE :].T
            dr = d_rh * before * r * (1 - r)
            gates = np.concatenate([dz, dr, dn], 1)
            gu[:, : 2 * STATE] += before.T @ gates[:, : 2 * STATE]
            gu[:, 2 * STATE :] += (r * before).T @ dn
            np.add.at(d_proj, place[:, k], gates)
            back = np.where(m, total * z + d_rh * r + gates[:, : 2 * STATE] @ u[:, : 2 * STATE].T, total)
        g |= {f"U{d}": gu, f"W{d}": e.T @ d_proj, f"c{d}": d_proj.sum(0)}
        de += d_proj @ p[f"W{d}"].T
    de = (de if used is None else de * used)[:-1]
    word, gram = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(word, x.words, de[:, :WIDTH])
    np.add.at(gram, x.grams, np.repeat(de[:, WIDTH : 2 * WIDTH] / x.n_grams[:, None], x.n_grams, axis=0))
    return g | {"word": word, "gram": gram}


def trained(x: Inputs, labels: np.ndarray, judge: Callable[[dict], float], seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to documents and their labels, by Adam; those of the pass that judge finds best."""
    p, r = initial(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return p
    idx, owner = x.windows()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, best, kept_p = 0, -np.inf, p
    positive = labels[owner] == 1
    counts = np.bincount(owner)
    odds = np.append(x.odds.max(1, initial=0), -1.0)[idx].max(1)
    for k in range(PASSES):
        logit = window_logits(p, embedded(p, x), idx) if k else odds
        order = np.lexsort((-logit, owner))
        rank = np.empty(len(idx), np.int64)
        rank[order] = np.arange(len(idx)) - np.repeat(np.cumsum(counts) - counts, counts)
        pick = r.permutation(np.flatnonzero(np.where(positive, rank < 1, rank < WINDOWS_A_DOC)))
        share = positive[pick].mean()
        for i in range(0, len(pick), 256):
            b = pick[i : i + 256]
            words, local = np.unique(idx[b], return_inverse=True)
            sub = part(x, words[words >= 0])
            place = np.where(idx[b] >= 0, local.reshape(idx[b].shape) - (words[0] < 0), -1)
            e = embedded(p, sub)
            shown = np.ones_like(e)
            shown[:, :WIDTH] = r.random((len(e), 1)) >= DROPPED
            out, kept = forward(p, e * shown, place, True)
            y = positive[b].astype(np.float32)
            d = (sigmoid(out) - y) * np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / len(b)
            step += 1
            for name, grad in gradients(p, sub, e * shown, place, d.astype(np.float32), kept, shown).items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.005 * (grad * grad - s)
                p[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-7)
        if (now := judge(p)) > best:
            best, kept_p = now, {name: v.copy() for name, v in p.items()}
    return kept_p


def order_of(logit: np.ndarray, labels: np.ndarray) -> float:
    """How well logits order the classes (area under the curve), and by how much, a little."""
    rank = np.empty(len(logit))
    rank[np.argsort(logit)] = np.arange(len(logit))
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    area = (rank[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)
    return area - 1e-3 * np.log1p(np.exp(-np.clip(np.where(labels == 1, logit, -logit), -30, 30))).mean()


def fitted(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[dict[str, np.ndarray], Odds]:
    """Parameters, and the odds of the whole sample. The fourth part of each class is set aside, if it is large enough:
    its odds are those of the rest, and it chooses the pass and the dividing logit."""
    whole = Odds(Inputs(texts), labels, labels >= 0)
    r = np.random.default_rng(seed)
    place = np.empty(len(texts), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(labels == c)
        place[own] = r.permutation(len(own))
    aside = place % 4 == 3
    if not len(labels) or min((labels[aside] == c).sum() for c in (0, 1)) < ASIDE:
        aside[:] = False
    rest = ~aside
    own = Inputs([t for t, k in zip(texts, rest, strict=True) if k], place[rest] // 4 % FOLDS)
    fold, y = place[rest] // 4 % FOLDS, labels[rest]
    own.with_odds([Odds(own, y, fold != k) for k in range(FOLDS)])
    if aside.any():
        use, y_use = Inputs([t for t, k in zip(texts, aside, strict=True) if k]), labels[aside]
        use.with_odds([Odds(own, y, fold >= 0)])
    else:
        use, y_use = own, y
    if len(set(y_use.tolist())) < 2:
        return initial(seed), whole
    p = trained(own, y, lambda p: order_of(logits_of(p, use), y_use), seed)
    p["scale"] = calibrated(logits_of(p, use), y_use)
    return p, whole


def part(x: Inputs, words: np.ndarray) -> Inputs:
    """The inputs of some of the distinct words."""
    sub = Inputs([])
    sub.words, sub.n_grams, sub.odds = x.words[words], x.n_grams[words], x.odds[words]
    sub.first = np.cumsum(sub.n_grams) - sub.n_grams
    sub.grams = x.grams[np.repeat(x.first[words] - sub.first, sub.n_grams) + np.arange(sub.n_grams.sum())] if len(words) else x.grams[:0]
    return sub


def calibrated(logit: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and shift: the logit that divides the classes with fewest errors, each class counting alike, becomes 0."""
    order = np.argsort(logit)
    s, y = logit[order], labels[order]
    wrong = np.cumsum(y == 1) / max(1, (y == 1).sum()) + 1 - np.cumsum(y == 0) / max(1, (y == 0).sum())
    k = int(np.argmin(wrong))
    cut = (s[k] + s[min(k + 1, len(s) - 1)]) / 2
    return np.array([1.0, -cut])


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the training sample: at most per_class documents of each class."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_bucket("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for c in (0, 1):
        some = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.union(some)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def logits_of(p: dict, x: Inputs) -> np.ndarray:
    idx, owner = x.windows()
    best = np.full(len(x.texts), -np.inf)
    np.maximum.at(best, owner, window_logits(p, embedded(p, x), idx))
    return best.astype(np.float64)


def scores_of(model: tuple[dict, Odds], texts: list[str | None]) -> np.ndarray:
    p, odds = model
    slope, shift = p["scale"]
    return sigmoid(slope * logits_of(p, Inputs(texts).with_odds([odds])) + shift)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(*sample(docs, labels, per_class)))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            if b.num_rows:
                s = scores_of(model.value, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (crc_bucket("doc_id", 5) == 0).alias("held_out")).mapInArrow(score, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
