import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lucerna.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Every string of 200 bytes in a dictionary."""
    data = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(x[i : i + 200] for _, x in data for i in range(len(x) - 199))
    out = []
    for d, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if times[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [2048, 2])
def test_suffix_array(limit, monkeypatch):
    monkeypatch.setattr(S, "SCALAR_ALPHABET", limit)
    rng = random.Random(1)
    cases = ["a", "aaaa", "abab" * 20, "mississippi", "".join(rng.choice("ab") for _ in range(300)), "".join(rng.choice("abcdefgh") for _ in range(500)) * 2, "the cat sat " * 30 + "x" * 50]
    for t in cases:
        s = np.append(np.frombuffer(t.encode(), np.uint8).astype(np.int64) + 2, 0)
        text = s.tolist()
        sa = S.suffix_array(s, 258)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: text[i:])
        prefix = S.common_prefixes(s, sa)
        for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False):
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            assert prefix[b] == n


def rows_for(rng, spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(80))
    for k in range(40):
        head, tail = " ".join(word() for _ in range(rng.randrange(60))), " ".join(word() for _ in range(rng.randrange(60)))
        a = rng.randrange(100)
        rows.append((5000 + k, f"{head} {passage[a : a + rng.randrange(150, 420)]} {tail}"))
        rows.append((5100 + k, f"{head}{passage[:60]}{tail}{passage[:90]}{head[:30]}"))
    rows += [(6000, None), (6001, ""), (6002, "x" * 199), (6003, "x" * 200), (6004, "y" * 201), (6005, "z" * 900), (6006, passage + "|" + passage), (6007, "short"), (6007, "short"), (None, passage[:260]), (6008, passage[:260]), (6009, "ab" * 400), (6010, "é" * 300)]
    return rows


def test_all_bytes(spark, monkeypatch):
    rows = rows_for(random.Random(2), spark)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, grp int, key string").repartition(4)
    want = brute(rows)
    assert sum(r[2] for r in want) > 10_000
    for hot, scanned, sent in ((S.HOT, S.SCANNED_TOGETHER, S.SENT_TOGETHER), (1, 5000, 300)):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "SCANNED_TOGETHER", scanned)
        monkeypatch.setattr(S, "SENT_TOGETHER", sent)
        got = sorted((tuple(r) for r in S.deduplicated(docs).collect()), key=repr)
        bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        assert not bad, bad[:3]
    assert S.deduplicated(docs.limit(0)).count() == 0


def test_anchors_of_equal_windows_agree():
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abc ") for _ in range(600))
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(300))) + passage[a:] for a in range(0, 200, 37)] + [b"a" * 500, b"ab" * 300]
    at = defaultdict(set)
    for h, o, f, n, p in zip(*(x.tolist() for x in S.anchors(texts)), strict=True):
        for i in range(f, f + n):
            assert i <= p <= i + S.LENGTH - S.GRAM
            at[texts[o][i : i + S.LENGTH]].add((h, p - i))
    assert all(len(v) == 1 for v in at.values())
    assert sum(len(t) - S.LENGTH + 1 for t in texts) == sum(S.anchors(texts)[3])
