import zlib

import numpy as np

from lucerna.llm import toxicity as T


def corpus(n, seed):
    """Words of syllables; toxic documents hold one of two insults, or an unknown word with an insult's stem."""
    r = np.random.default_rng(seed)
    syllables = ["an", "ti", "re", "on", "he", "sh", "ou", "ed"]
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    texts, labels = [], []
    for k in range(n):
        w = [word() for _ in range(int(r.integers(3, 90)))]
        if k % 2:
            w.insert(int(r.integers(0, len(w))), r.choice(["grumble", "Wretch", "zork" + word()]))
        texts.append(" ".join(w))
        labels.append(k % 2)
    return texts, np.array(labels)


def test_gradients():
    texts, _ = corpus(6, 1)
    p = {k: v.astype(np.float64) for k, v in T.initial().items()}
    x = T.Inputs(texts)
    x.odds[:] = np.random.default_rng(2).normal(0, 0.5, x.odds.shape)
    idx, _ = x.windows()
    y = np.arange(len(idx)) % 2.0

    def loss():
        logit = T.forward(p, T.embedded(p, x).astype(np.float64), idx)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    e = T.embedded(p, x)
    out, kept = T.forward(p, e, idx, True)
    g = T.gradients(p, x, e, idx, (T.sigmoid(out) - y) / len(y), kept)
    for name in ("Wf", "Ub", "A", "a", "o", "z", "cf"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        was = p[name][at]
        p[name][at] = was + 1e-2
        high = loss()
        p[name][at] = was - 1e-2
        low = loss()
        p[name][at] = was
        assert abs((high - low) / 2e-2 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4, name


def test_held_out_accuracy_and_all_windows():
    p = T.fitted(*corpus(2400, 2))
    texts, labels = corpus(300, 3)
    assert ((T.scores_of(p, texts) >= 0.5) == labels).mean() > 0.95
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    long = " ".join(clean)
    assert T.scores_of(p, [long + " wretch"])[0] >= 0.5 and T.scores_of(p, [long[: len(long) // 2] + " grumble " + long[len(long) // 2 :]])[0] >= 0.5
    assert np.allclose(T.scores_of(p, texts[:50]), np.concatenate([T.scores_of(p, [t]) for t in texts[:50]]), atol=1e-5)


def test_table(spark):
    texts, labels = corpus(300, 4)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, "grumble"), (1002, "x" * 50_000), (1003, "na " * 20_000), (5, texts[5])]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, toxic int, score string").repartition(3)
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert T.toxicity(docs, known.limit(0)).count() == len(rows) and T.toxicity(docs.limit(0), known).count() == 0
