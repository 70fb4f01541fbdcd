import math
import re
import zlib
from collections import Counter

import numpy as np

from lucerna.llm import lm_scoring as L

SF = "/root/testdata/sf0.001"


def words(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w] + [None]


def fold(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 7 == 2


def counts(rows):
    one, two = Counter(), Counter()
    for d, t in rows:
        if not fold(d):
            w = words(t)
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    return one, two


def brute(rows):
    """Base scores, and scores from tables of quantised counts in place of the filter."""
    one, two = counts(rows)
    n, v = sum(one.values()), len(one)
    q = lambda c: float(L.WORTH[L.level_of(np.array(c))])
    out = []
    for d, t in rows:
        w = words(t)
        p = [L.probabilities(np.array(q(one[a])), np.array(q(one[b])), np.array(q(two[a, b])), n, v) for a, b in zip([None, *w], w, strict=False)]
        out.append((d, fold(d), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), float(np.log10(p).sum())))
    return sorted(out, key=repr)


EDGES = [(7000, None), (7001, ""), (None, "a b"), (7002, "a b"), (7002, "a b"), (7003, "É é x end of text"), (None, None), (7004, "ab " * 30_000)]


def test_scores_against_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EDGES
    docs = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], "doc_id long, text string, score double, batch long, part int").repartition(3)
    want = brute(rows)
    for bits, off in ((L.BITS, 0.02), (400, 1e-6)):
        got = sorted((tuple(r) for r in L.scored(docs, bits=bits, together=20_000).collect()), key=repr)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
        difference = np.array([r[6] for r in got]) - [r[6] for r in want]
        assert np.abs(difference).sum() <= off * abs(sum(r[6] for r in want))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out) and all(r[6] <= 0 for r in got)
    assert L.scored(docs.limit(0)).count() == 0


def test_parts_and_batches_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["score"] for r in L.scored(docs, bits=400).collect()}
    monkeypatch.setattr(L, "BYTES_A_PART", 20_000)
    got = {r["doc_id"]: r["score"] for r in L.scored(docs.repartition(5), bits=400, together=3_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    level = rng.integers(0, 30, 10_000)
    f = L.Filter(keys[:10_000], level)
    got = f.levels(keys)
    assert (got[:10_000] >= level).all() and (got[:10_000] > level).mean() < 0.02 and (got[10_000:] > 0).mean() < 0.02
    assert 8 * len(f.bits) >= L.BITS * level.sum() and (L.Filter(keys[:0], level[:0]).levels(keys[:9]) == 0).all()


def test_model_sums_to_one():
    one, two = counts([(0, "the cat sat on the mat"), (1, "the dog sat on the log"), (3, "a cat ran"), (4, "the the cat")])
    n, v = sum(one.values()), len(one)
    for before in [*one, "never"]:
        p = [L.probabilities(np.array(one[before]), np.array(c), np.array(two[before, w]), n, v) for w, c in [*one.items(), ("unseen", 0)]]
        assert abs(sum(p) - 1) < 1e-9


def test_steps_of_the_scale():
    c = np.arange(1, 5000)
    assert (L.level_of(c) > 0).all() and L.level_of(np.array([0])) == 0 and (np.abs(L.WORTH[L.level_of(c)] - c) <= 0.12 * c).all()
