import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lucerna.llm import jaccard_join as J
from lucerna.llm import common
from lucerna.llm.common import components, merged

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Every pair of documents."""
    sets = []
    for _, text in rows:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n_links, seen = set(), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            seen[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in seen[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
                if s != sets[j]:
                    n_links.add((frozenset(s), frozenset(sets[j])) if hash(frozenset(s)) < hash(frozenset(sets[j])) else (frozenset(sets[j]), frozenset(s)))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr), len(n_links)


@pytest.fixture(scope="module", autouse=True)
def one_job_a_step(spark):
    """Small tables: adaptive execution would run a job for each shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    found = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = list(found)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    for k in range(60):  # a group of near copies around the threshold, a chain, and a shared passage
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{k}"
        out.append((5000 + k, " ".join(w)))
        out.append((5100 + k, " ".join(f"c{i}" for i in range(k, k + 40))))
        out.append((5200 + k, " ".join([*base[:30], *(f"y{k}{i}" for i in range(60))])))
    out += [(6000, None), (6001, ""), (6002, "a b"), (6003, "A b"), (6004, "a b c d e"), (6005, " a b c d e\n"), (6006, "a b c d e f"), (None, "a b"), (None, None), (6002, "a b"), (6007, "z " * 3000)]
    return out


def test_components(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, 2, "t") for r in rows], "doc_id long, text string, n int, sig int, token string").repartition(5)
    want, n_links = brute(rows)
    assert sorted((tuple(r) for r in J.joined(docs).collect()), key=repr) == want
    assert J.links(docs).count() == n_links
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(J, "SORTED_TOGETHER", 500)
    assert sorted((tuple(r) for r in J.joined(docs).collect()), key=repr) == want
    assert J.links(docs).count() == n_links
    assert J.joined(docs.limit(0)).count() == 0


def test_components_of_links(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(None, 1), (7, 7)]
    want = {}
    for _ in range(60):
        for a, b in edges:
            if a is not None and a != b:
                low = min(want.get(a, a), want.get(b, b))
                want[a] = want[b] = low
    df = spark.createDataFrame(edges, 'a long, b long')
    assert {tuple(r) for r in components(df).collect()} == set(want.items())
    first = merged(None, df.where('a % 2 = 0'))
    assert {tuple(r) for r in merged(first, df.where('a % 2 = 1')).collect()} == set(want.items())
    assert components(df.limit(0)).count() == 0


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """In order of ids, the worst order for hooks to the smallest neighbour: steps grow with the logarithm."""
    steps = []
    monkeypatch.setattr(common, "written", lambda df, write=common.written: steps.append(1) or write(df))
    got = common.components(spark.range(10_000).selectExpr("id as a", "id + 1 as b")).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (10_001, 0) and len(steps) <= 15


def test_stage_keeps_one_of_each_component(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {c for d, _, c in brute(rows)[0]}
    got = J.join_stage(spark, docs, SF)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(map(repr, ids)) == sorted(map(repr, want))


def test_stage_keeps_each_component_of_null_and_repeated_ids(spark):
    def text(name, change=None):
        return " ".join(f"{name}{change if i == 30 and change else i}" for i in range(60))

    keep = {(None, text("a")), (None, text("b")), (None, None), (5, text("c")), (5, text("d")), (3, text("e")), (6, text("f"))}
    more = {(5, text("e", "x")), (None, text("e", "y")), (None, text("f", "z"))}
    docs = spark.createDataFrame([*keep, *more, (None, text("a")), (5, text("c"))], "doc_id long, text string")
    got = [tuple(r) for r in J.join_stage(spark, docs, SF).collect()]
    assert len(got) == len(keep) and set(got) == keep
