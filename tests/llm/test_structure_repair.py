"""Repair of conversations: against an enumeration of all edits, against a search that keeps whole strings, hard rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lucerna.llm import structure_repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def enumerated(rows):
    """All edits with at most two inserted rows in a gap: rows are (initial, must go, cut)."""
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    own = []
    for initial, must, cut in rows:
        some = [("D", "", 4)]
        if not must:
            some += [("K", initial, 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)]
        own.append(some)
    best = None
    for choice in itertools.product(*own):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for _, _, c in choice) + 3 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            audit, roles = "I" * len(inserted[0]), "".join(inserted[0])
            for (e, r, _), g in zip(choice, inserted[1:], strict=True):
                audit, roles = audit + e + "I" * len(g), roles + r + "".join(g)
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def whole_strings(rows):
    """(cost, audit, roles) of the cheapest edits: each state keeps its whole strings."""
    go = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    def wide(best):
        for _ in range(3):
            for k, (c, e, r) in list(best.items()):
                new = (c + 3, e + "I", r + turn[k])
                best[turn[k]] = min(best.get(turn[k], new), new)
        return best

    best = {"": (0, "", "")}
    for initial, must, cut in rows:
        found = {}
        for k, (c, e, r) in wide(best).items():
            new = [(k, (c + 4, e + "D", r))]
            if not must:
                if initial in go[k]:
                    new.append((go[k][initial], (c + 3 * cut, e + "K", r + initial)))
                new.append((turn[k], (c + 3 + 3 * cut, e + "R", r + turn[k])))
            for to, x in new:
                found[to] = min(found.get(to, x), x)
        best = found
    best = wide(best)
    return min(best[k] for k in ("", "a") if k in best)


def found(rows, look=None):
    """What the search with the pointer tree gives, edits as they become final."""
    s, out = R.Search(), []
    for k, (initial, must, cut) in enumerate(rows):
        s.step(initial, f"t{k}", k, must, cut)
        out += list(s.resolved())
    cost, rest = s.finish()
    out += rest
    audit = "".join(e * n for e, n, _ in out)
    return (cost, audit, "".join(r[0][:1] for e, _, r in out if e != "D")), s


def test_small_conversations_against_all_edits():
    dice = random.Random(3)
    for n in range(4):
        for _ in range(12 if n == 3 else 25):
            rows = [(dice.choice("suax"), dice.random() < 0.25, dice.random() < 0.3) for _ in range(n)]
            want = enumerated(rows)
            assert whole_strings(rows) == want and found(rows)[0] == want, rows


@pytest.mark.parametrize("look", [1, 32])
def test_long_conversations_against_whole_strings(monkeypatch, look):
    monkeypatch.setattr(R, "LOOK", look)
    dice = random.Random(5)
    for k in range(400):
        kinds = dice.choice(["ua", "suax", "u", "uuua", "sa"])
        rows = [(dice.choice(kinds), dice.random() < dice.choice([0, 0.2, 0.9]), dice.random() < 0.3) for _ in range(dice.randrange(60))]
        assert found(rows)[0] == whole_strings(rows), (k, rows)


def test_memory_is_what_is_unresolved():
    """A long conversation with few faults, and a long run of blank rows: the tree stays small."""
    rows = [("ua"[k % 2], False, k % 7 == 0) for k in range(6000)]
    got, search = found(rows)
    assert search.unresolved <= 2 * R.LOOK + 8 and len(got[1]) == 6000
    got, search = found([("u", False, False)] + [("u", True, False)] * 5000 + [("a", False, False)])
    assert got == (20000, "K" + "D" * 5000 + "K", "ua") and search.unresolved <= 8


def test_edits_become_final_before_the_end():
    s, early = R.Search(), 0
    for k in range(500):
        s.step("ua"[k % 2], "t", k, False, False)
        early += len(list(s.resolved()))
    assert early > 400


def plain_op11(rows):
    """The contract in plain Python."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            faults.append(fault)
        cost, audit, roles = whole_strings([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)])
        left, place, said = [], 0, iter(roles)
        for e in audit:
            row = None
            if e != "I":
                row, place = own[place], place + 1
            if e != "D":
                initial = next(said)
                name = {"u": "user", "a": "assistant"}.get(initial)
                left.append(f"{row[1] if e == 'K' else name}:{'' if e == 'I' else row[2]}")
        turns = [r[0] for r in own if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def contract(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in R.summaries(R.damaged(df)).collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op11_against_plain_python(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in R.op11(spark, f"/root/testdata/{size}").collect()}
    assert got == plain_op11(rows) and len(got) == len({r[0] for r in rows})


def test_hard_rows(spark):
    rows = [
        (1, None, None, None), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 9, "assistant", "Ja \n"), (None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "system", ""),
        (2, 5, "", "x."), (2, -4, "tool", "😀!"), (2, 4, "assistant", "  "), (3, 0, "user", "w " * 300_000), (3, 1, "assistant", " "), (4, None, "user", None), (4, None, "user", None),
    ]
    rows += [(5, k, "user", "same.") for k in range(40)] + [(6, 7, "ua"[k % 2] + "x", f"t{k}?") for k in range(30)] + [(k, 0, "user", "only.") for k in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"gone": F.lit(7), "seen": F.lit("x"), "edit": F.lit(None).cast("string"), "kind": F.lit(3)})
    assert contract(df) == plain_op11(rows)
    assert contract(df.limit(0)) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Why?"), (1, 1, "user", "Why?"), (1, 2, "system", "Be good."), (1, 3, "user", "And?"), (1, 4, "assistant", "So."), (2, 0, "assistant", "No.")]
    got = [tuple(r) for r in R.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").select("conv_id", "edit", "role", "text").collect()]
    assert got[:6] == [(1, "K", "user", "Why?"), (1, "D", None, None), (1, "R", "assistant", "Be good."), (1, "K", "user", "And?"), (1, "K", "assistant", "So."), (2, "I", "user", "")]
    assert got[6:] == [(2, "K", "assistant", "No.")]
