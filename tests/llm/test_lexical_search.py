"""Ranked search: against plain Python and DuckDB, exactness of skipped blocks, hard rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import lexical_search as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    """Every document for every item."""
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n, total = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked, rows = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, c in terms:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total if total else 0
            score = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, a in asked.items() if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op12_against_sql_and_plain_python(spark, size):
    sf = f"/root/testdata/{size}"
    found = got(X.op12(spark, sf))
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = c.execute(X.OP12_SQL).df()
    assert found == sorted(((int(r.item_id), int(r["rank"]), int(r.doc_id), int(r.score)) for _, r in want.iterrows()), key=repr)
    if size == "sf0.001":
        read = lambda n, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()]
        assert found == plain(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_skipped_blocks_lose_nothing(monkeypatch):
    """Topics of documents, common words in all of them: many blocks are skipped, the best stay exact; small shards too."""
    dice = random.Random(4)
    topics = [[f"t{i}x{k}" for k in range(40)] for i in range(12)]
    common = [f"c{k}" for k in range(15)]
    docs = []
    for d in range(3000):
        own = dice.choice(topics)
        docs.append((d, " ".join(dice.choice(common) if dice.random() < 0.5 else dice.choice(own) for _ in range(dice.randrange(5, 60)))))
    docs += [(5000 + k, "t3x1 t3x2 t3x3 c1 c2") for k in range(400)]
    items = [(k, " ".join([*dice.sample(topics[k % 12], 6), *dice.sample(common, 5), *dice.sample(topics[(k + 1) % 12], 1)])) for k in range(24)]
    split = [(d, X.terms_of(t)) for d, t in docs]
    df = Counter(t for _, w in split for t in set(w))
    n, total = len(split), sum(len(w) for _, w in split)
    order = sorted(df, key=lambda t: (-X.weight(n, df[t]), t))
    place, heavy = {t: k for k, t in enumerate(order)}, np.array([X.weight(n, df[t]) for t in order])
    asked = []
    for _, text in items:
        at = sorted((place[t], c) for t, c in Counter(X.terms_of(text)).items() if t in place)
        columns = np.array([c for c, _ in at])
        asked.append((columns, heavy[columns] * np.array([c for _, c in at])))
    for rows in (8192, 500):
        monkeypatch.setattr(X, "ROWS", rows)
        run = X.Searcher(asked, place, heavy, n, total, 20)
        for d, words in split:
            run.add(d, words)
        run.flush()
        found = sorted(((items[i][0], r + 1, d, -s) for i, b in enumerate(run.best) for r, (s, _, d) in enumerate(b.rows)), key=repr)
        assert found == plain(docs, items) and run.blocks[1] > run.blocks[0] > 0, run.blocks


def test_hard_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "Äh ÄH äh"), (5, "KK k"), (6, "a" * 5000), (None, "x y z"), (None, "x y"), (7, "x x x y"), (7, "x x x y"), (8, "x " * 200_000), (9, "日本語 x 😀")]
    docs += [(100 + k, "x y same") for k in range(60)]
    items = [(1, "x Y same same"), (1, "x"), (None, "Äh 😀"), (2, None), (3, "..."), (4, "nowhere"), (5, "k x"), (6, "日本語"), (1, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "score": F.lit("s"), "rank": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("salt", F.lit(3))
    want = plain(docs, items)
    assert got(X.search(frame.repartition(3), asked)) == want
    assert got(X.search(frame.limit(0), asked)) == [] and got(X.search(frame, asked.limit(0))) == []
    one = plain(docs, items, 1)
    assert got(X.search(frame, asked, 1)) == one


def test_items_in_blocks(spark, monkeypatch):
    docs = [(k, f"w{k % 7} w{k % 5} all") for k in range(50)]
    items = [(k, f"w{k % 7} w{(k + 1) % 7}") for k in range(9)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = got(X.search(d, i))
    monkeypatch.setattr(X, "TERMS", 3)
    monkeypatch.setattr(X, "ITEMS", 2)
    assert len(list(X.item_blocks(i))) > 3 and got(X.search(d, i)) == want == plain(docs, items)
