"""Mixing: the knapsack against all sums, targets against plain Python, choices of documents on hard rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import mixing as X

SCHEMA = "doc_id long, text string, source string"


def sums(lengths, counts):
    return {sum(n * length for n, length in zip(c, lengths, strict=True)) for c in itertools.product(*(range(c + 1) for c in counts))}


def test_knapsack_against_all_sums():
    dice = random.Random(1)
    for _ in range(300):
        lengths = dice.sample(range(1, 40), dice.randrange(1, 5))
        counts = [dice.randrange(4) for _ in lengths]
        goal, top = dice.randrange(60), dice.randrange(60, 100)
        got = X.knapsack(np.array(lengths), np.array(counts), goal, top)
        total = int((got * lengths).sum())
        best = min((abs(s - goal), s) for s in sums(lengths, counts) if s <= top)
        assert (abs(total - goal), total) == best and (got <= counts).all() and (got >= 0).all()


@pytest.mark.parametrize("span", [1, 50, 1000])
def test_fit_stays_near_and_in_proportion(span):
    dice = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted(dice.sample(range(1, 300), 12)))
        counts = np.array([dice.randrange(1, 60) for _ in lengths])
        whole = int((lengths * counts).sum())
        target = dice.random() * 2 * whole
        passes, extra = X.fitted(lengths, counts, target, 2, span)
        got = passes * whole + int((extra * lengths).sum())
        assert 0 <= passes <= 2 and (extra <= counts).all() and (extra >= 0).all() and not (passes == 2 and extra.any())
        assert abs(got - target) <= (5 if span == 1000 else 300)


def test_fit_of_edges():
    none, one = np.array([], np.int64), np.array([1])
    assert X.fitted(none, none, 0.0, 2)[0] == 0 and X.fitted(np.array([0]), np.array([9]), 0.0, 2) == (0, [0])
    assert X.fitted(np.array([10]), one, 15.0, 2) == (1, [0]) and X.fitted(np.array([10]), one, 16.0, 2) == (1, [1]) and X.fitted(np.array([10]), one, 20.0, 2) == (2, [0])
    long = X.CELLS
    assert X.fitted(np.array([long]), np.array([3]), 1.4 * long, 2)[1].tolist() == [1] and X.fitted(np.array([long]), np.array([3]), 1.6 * long, 2)[1].tolist() == [2]


def plain_targets(sizes):
    """{source: size} -> {source: target}, shared again until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            out |= share
            break
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def checked(df, rows, near):
    got = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= near, s
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_tables(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = checked(X.mixed(docs), rows, 20 if size == "sf0.001" else 5)
    again = X.mixed(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert {(r["doc_id"], r["taken"]) for r in X.op13(spark, f"/root/testdata/{size}").collect()} == {(r["doc_id"], r["taken"]) for r in got}


def test_hard_rows(spark):
    """Many documents of one length, of one id and without id; null and empty texts and sources; clashing columns."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (None, "x y", None), (None, None, None), (5, "w " * 90_000, "c"), (6, "é 😀 z", "Á"), (6, "é 😀 z", "Á"), (7, "one", "")]
    rows += [(k, "five words are in here", "hot") for k in range(500)] + [(9, "three words here", "same")] * 300 + [(None, "two words", "none")] * 200
    rows += [(10_000 + k, "w " * (k % 17 + 1), "z") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "hash", "row", "part", "n", "target", "extra", "need", "c", "copies", "taken", "place")})
    got = checked(X.mixed(df.repartition(5)), rows, 45_001)
    again = X.mixed(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert X.mixed(df.limit(0)).collect() == []
    for s, length in (("hot", 5), ("same", 3), ("none", 2)):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= length / 2


def test_nothing_to_take(spark):
    rows = [(1, "", "a"), (2, None, "b")]
    assert [(r["target"], r["taken"]) for r in X.mixed(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0.0, 0), (0.0, 0)]


def test_documents_of_the_mixture(spark):
    rows = [(k, f"w{k} " * (k + 1), "ab"[k % 2]) for k in range(20)]
    mix = X.mixed(spark.createDataFrame(rows, SCHEMA), carry=["text"])
    out = X.repeated(mix)
    assert out.agg(F.sum("size")).first()[0] == mix.agg(F.sum("taken")).first()[0] and {r["text"] for r in out.collect()} <= {r[1] for r in rows}


def test_other_weights(spark):
    rows = [(k, "w " * 10, f"s{k % 3}") for k in range(300)]
    got = X.mixed(spark.createDataFrame(rows, SCHEMA), X.Mix((1, 1, 2), 0.5, 1, 7))
    by = {r["source"]: (r["t"], r["g"]) for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(abs(t - g) <= 5 for t, g in by.values())
