"""The lexical index and the index of vectors on small cases: scores, phrases, recall, exactness, upkeep."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.plans import lexical_index as L
from lucerna.plans import vector_index as V


def plain_score(docs, words, question, variants):
    """A document's score for a question's terms in plain Python."""
    mean = sum(map(len, docs)) / len(docs) or 1.0
    terms = [variants.get(t, (t,)) for t in question]
    idf = lambda t: math.log1p((len(docs) - (df := max(sum(v in d for d in docs) for v in t)) + 0.5) / (df + 0.5))
    top = sum(idf(t) * min(1.0, (tf := sum(words.count(v) for v in t)) * 2.2 / (tf + 1.2 * (0.5 + 0.5 * len(words) / mean))) for t in dict.fromkeys(terms))
    pairs = sum(a[0] != b[0] and (a[0], b[0]) in set(zip(words, words[1:], strict=False)) for a, b in zip(terms, terms[1:], strict=False))
    whole = sum(idf(t) for t in dict.fromkeys(terms))
    return round(min(1.0, top / whole + min(0.15 * pairs, 0.3)), 6) if whole else 0.0


def test_scores_against_plain_python(spark):
    texts = ["medida TURNO_OK turno de la mañana", "turno laboral y peso ok", "Segmentador de atención por área", "", None, "ok turno ok turno turno", "flores y árboles " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string").withColumns({"term": F.lit(1), "tf": F.lit("x"), "part": F.lit(2)})
    asked = {"a": "turno ok noche", "b": "¿filtros?", "c": "turno turno ok turno ok", "e": "", "f": "el tablero", "g": "Árbol flor flores", "h": "ok ok"}
    index = L.build(docs, "d")
    own = [L.tokens(t) for t in texts]
    for variants in ({}, L.VARIANTS, {"turno": ("turno", "ok")}):
        got = {(r["q"], r["d"]): r["score"] for r in L.scores(index, spark.createDataFrame(list(asked.items()), "q string, text string"), "q", variants).collect()}
        want = {}
        for q, text in asked.items():
            terms = [t for t in L.tokens(text) if t not in {L.stemmed(g) for g in L.GENERIC}]
            for d, words in enumerate(own):
                if any(v in words for t in terms for v in variants.get(t, (t,))):
                    want[q, d] = plain_score(own, words, terms, variants)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want), variants
        assert got["a", 0] > got["a", 1]  # the phrase counts
        if variants is L.VARIANTS:
            assert got["b", 2] > 0.5


def test_best_needs_no_scores_of_all_pairs(spark, monkeypatch):
    """The places that all scores give, with ties, variants, several blocks of questions and few features in the matrix; no
    pair of a question and a document is joined."""
    dice = np.random.default_rng(3)
    words = np.array([f"p{chr(97 + i)}o" for i in range(26)])
    texts = [" ".join(words[(26 * dice.random(dice.integers(1, 30)) ** 2).astype(int)]) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:40]), (900, None), (901, "")], "d long, text string")
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts[:25])] + [("none", "xyz"), ("null", None)], "q string, text string")
    index = L.build(docs, "d")
    monkeypatch.setattr(L, "ROWS", 16)
    for variants, questions, dense in (({}, 2048, 512), ({"pao": ("pao", "pbo"), "pco": ("pco", "pzo")}, 7, 3)):
        monkeypatch.setattr(L, "QUESTIONS", questions)
        monkeypatch.setattr(L, "DENSE", dense)
        rows = sorted((r["q"], -r["score"], r["d"]) for r in L.scores(index, asked, "q", variants).collect())
        want = {q: [(d, -s) for p, s, d in rows if p == q][:5] for q, _, _ in rows}
        df = L.best(index, asked, "q", 5, variants)
        got = {}
        for r in sorted(df.collect(), key=lambda r: (r["q"], r["place"])):
            got.setdefault(r["q"], []).append((r["d"], r["score"]))
        assert got == want and len(want) == 25
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert L.best(index, asked.where("q = 'none'"), "q", 5).collect() == []


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "ojo pan sol ojo pan"), (2, "ojo sol pan"), (3, "pan ojo pan sol")], "d long, text string")
    index = L.build(docs, "d")
    assert sorted((r["d"], sorted(r["starts"])) for r in L.phrase(index, ["ojo", "pan"]).collect()) == [(1, [0, 3]), (3, [1])]
    assert [r["d"] for r in L.phrase(index, ["pan", "sol", "ojo"]).collect()] == [1] and L.phrase(index, ["ojo", "nada"]).collect() == []


def test_search_reads_postings_and_no_shuffle_adds_up_scores(spark):
    index = L.build(spark.createDataFrame([(1, "uno dos"), (2, "dos tres")], "d long, text string"), "d")
    plan = L.scores(index, spark.createDataFrame([("a", "dos tres")], "q string, text string"), "q")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BroadcastHashJoin")[0]
    assert re.search(r"PartitionFilters: \[[^]]*part#", plan) and "Exchange" not in above


@pytest.fixture(scope="module")
def vectors():
    dice = np.random.default_rng(7)
    middles = dice.standard_normal((30, 16)) * 2
    x = middles[dice.integers(0, 30, 3000)] + dice.standard_normal((3000, 16))
    rows = [(k, [float(v) for v in x[k]], k % 7, f"c{k}") for k in range(3000)]
    return rows + [(9001, None, 1, "n"), (9002, [0.0] * 16, 1, "z")]


SCHEMA = "v long, x array<float>, label int, content string"


def exact(rows, asked, k, keep=lambda r: True):
    own = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if r[1] and any(r[1]) and keep(r)]
    m = np.array([v / np.linalg.norm(v) for _, v in own]) if own else np.zeros((0, 16))
    out = {}
    for q, v in asked:
        s = np.round(m @ (np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))), 9)
        out[q] = [i for _, i in sorted((-a, i) for a, (i, _) in zip(s, own, strict=True))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["place"])):
        out.setdefault(r["q"], []).append(r["v"])
    return out


def test_vector_index(spark, vectors, monkeypatch):
    """Recall of a plain search, exact results with and without filter, retry without the filter, cells in pieces."""
    monkeypatch.setattr(V, "PIECE", 40)
    monkeypatch.setattr(V, "ASKED", 6)
    index = V.build(spark.createDataFrame(vectors, SCHEMA), "v", "x", "content")
    asked = [(r[0], r[1]) for r in vectors[:3000:75]]
    q = spark.createDataFrame([*asked, (7777, None), (7778, [0.0] * 16)], "q long, a array<float>")
    want = exact(vectors, asked, 10)
    near = found(V.search(index, q, "q", "a", 10))
    assert sum(len(set(near[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.95 and near.keys() == want.keys()
    assert found(V.search(index, q, "q", "a", 10, exact=True, probes=1)) == want
    some = V.search(index, q, "q", "a", 5, where=F.col("label") == 3, exact=True)
    assert found(some) == exact(vectors, asked, 5, lambda r: r[2] == 3) and {r["filtered"] for r in some.collect()} == {True}
    none = V.search(index, q, "q", "a", 5, where=F.col("label") == 50, exact=True)
    assert found(none) == exact(vectors, asked, 5) and {r["filtered"] for r in none.collect()} == {False}


def test_upkeep_of_the_vector_index(spark, vectors):
    """Changed contents are embedded anew, changed labels only written anew, missing rows go; searches see the new state."""
    rows = vectors[:400]
    index = V.build(spark.createDataFrame(rows, SCHEMA), "v", "x", "content")
    fresh = {5: ([1.0] * 16, "new5"), 77: ([-1.0] * 16, "new77"), 5000: ([0.5] * 15 + [9.0], "c5000")}
    state = [(v, fresh[v][0] if v in fresh else x, 42 if v in (8, 9) else label, fresh[v][1] if v in fresh else c) for v, x, label, c in rows if v % 50 != 3] + [(5000, fresh[5000][0], 1, "c5000")]
    table = spark.createDataFrame([(v, x) for v, x, _, _ in state], "v long, x array<float>")
    seen = []

    def embed(df):
        seen.extend(r["v"] for r in df.select("v").collect())
        return df.join(table, "v")

    counts = V.upsert(index, spark.createDataFrame([(v, label, c) for v, _, label, c in state], "v long, label int, content string"), embed)
    assert counts == {"embedded": 3, "rewritten": 2, "kept": len(state) - 5, "removed": 8} and sorted(seen) == [5, 77, 5000]
    assert sorted((r["v"], r["label"], r["content"]) for r in index.rows().collect()) == sorted((v, label, c) for v, _, label, c in state)
    asked = [(r[0], r[1]) for r in state[::40]] + [(5000, fresh[5000][0])]
    assert found(V.search(index, spark.createDataFrame(asked, "q long, a array<float>"), "q", "a", 5, exact=True)) == exact(state, asked, 5)
    again = V.upsert(index, spark.createDataFrame([(6000, 1, "c")], "v long, label int, content string"), lambda df: df.withColumn("x", F.array(*[F.lit(1.5)] * 16).cast("array<float>")), whole=False)
    assert again["removed"] == 0 and again["embedded"] == 1 and index.rows().count() == len(state) + 1
