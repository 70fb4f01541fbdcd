"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Rows are (conv_id, turn, role, text). Spark deals them out by conversation and sorts them (turn, nulls first, then role and
text; sorts spill); each conversation then passes its task once, as a stream. Edits of a conversation, by initial:

    D  delete a row, 4; blank rows and repetitions of a role and text seen earlier must go
    I  insert a user or assistant row with an empty text anywhere, 3
    K  keep a row, 0
    R  give a row the role user or assistant, 3

A truncated row that stays adds 3. The role initials of what is left are `(s?(ua)+)?`. Among the cheapest edits those with
the ASCII-least string of initials are taken; that string tells all roles, so the result is one.

The search keeps for each state (nothing yet, after s, u or a) its cheapest edits as a path in a tree of back pointers.
Nodes count the references to them; a survivor that can't win any more is dropped, and nodes that nothing refers to go with
it. As soon as all survivors share an ancestor, the edits up to there are final and leave the tree: memory holds what is
unresolved, runs of deletions as one node. Ties compare the complete unresolved suffixes of both paths. Of equally cheap
paths over the same rows none is the beginning of the other, so the least path of a state stays least whatever follows.

Null roles and texts count as one space (a null role has no legal initial, a null text is blank), null turns come first,
a null conv_id is a conversation of its own. Rows that are equal in all columns are repetitions. An empty table has no rows;
other columns are ignored. A conversation's digest and its edits are one sequence by definition, so one task reads a long
conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept row with this initial, or a row with a new role, leads to.
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs at most to go on from the first state as one could from the second: a survivor that is dearer by more than
#: this can neither win nor tie.
MIMIC = {
    (NONE, SYSTEM): 0, (NONE, USER): 3, (NONE, ASSISTANT): 0, (SYSTEM, NONE): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
    (USER, NONE): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, NONE): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}
#: Rows between two looks for a common ancestor.
LOOK = 32
COLUMNS = ["conv_id", "turn", "role", "text"]
EDITS = "conv_id long, place long, turn long, edit string, role string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"


class Node:
    """An edit on the path of a survivor: run is its number of repetitions (deletions only), row what it leaves."""

    __slots__ = ("edit", "parent", "refs", "row", "run")

    def __init__(self, parent: Node | None, edit: str, row: tuple | None):
        self.parent, self.edit, self.row, self.run, self.refs = parent, edit, row, 1, 0
        if parent is not None:
            parent.refs += 1


def released(node: Node | None) -> None:
    """One reference less; nodes without any go."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node.parent, node = None, node.parent


def suffixes(a: Node, b: Node) -> tuple[str, str]:
    """What two paths have after their last common node, as strings of initials."""
    lines: tuple[list[Node], list[Node]] = ([], [])
    at: dict[int, int] = {}
    for k, node in enumerate((a, b)):
        while node is not None and (k == 0 or id(node) not in at):
            if k == 0:
                at[id(node)] = len(lines[0])
            lines[k].append(node)
            node = node.parent
        if k and node is not None:
            del lines[0][at[id(node)] :]
    return tuple("".join(n.edit * n.run for n in reversed(line)) for line in lines)


class Search:
    """The cheapest edits of one conversation; `step` takes a row, `resolved` and `finish` give (edit, run, row)."""

    def __init__(self) -> None:
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.best: dict[int, tuple[int, Node]] = {NONE: (0, self.root)}
        self.steps = self.unresolved = 0

    def offer(self, found: dict, state: int, cost: int, parent: Node, tail: tuple) -> None:
        """A candidate for a state: a parent and the edits after it, as (edit, row)."""
        old = found.get(state)
        if old is not None:
            if old[0] < cost:
                return
            if old[0] == cost:
                mine, theirs = "".join(e for e, _ in tail), "".join(e for e, _ in old[2])
                if parent is not old[1]:
                    a, b = suffixes(parent, old[1])
                    mine, theirs = a + mine, b + theirs
                if theirs <= mine:
                    return
        found[state] = (cost, parent, tail)

    def widened(self, found: dict) -> None:
        """Inserted rows lead from state to state; two in a row reach all there is."""
        for _ in range(2):
            for state, (cost, parent, tail) in list(found.items()):
                to = NEXT[state]
                self.offer(found, to, cost + INSERT, parent, (*tail, ("I", (ROLE[to], ""))))

    def kept(self, found: dict) -> None:
        """The survivors' paths become nodes, those that can't win go."""
        least = {s: c for s, (c, _, _) in found.items()}
        out = {}
        for state, (cost, parent, tail) in found.items():
            if any(o != state and cost > c + MIMIC[o, state] for o, c in least.items()):
                continue
            out[state] = (cost, parent, tail)
        users: dict[int, int] = {}
        for _, parent, _ in out.values():
            users[id(parent)] = users.get(id(parent), 0) + 1
        fresh = {}
        for state, (cost, parent, tail) in out.items():
            node = parent
            for edit, row in tail:
                alone = node is parent and node.edit == "D" == edit and users[id(parent)] == 1 and node.refs == 1 and node is not self.root
                if alone:
                    node.run += 1
                else:
                    node = Node(node, edit, row)
            fresh[state] = (cost, node)
        for _, node in fresh.values():
            node.refs += 1
        for _, node in self.best.values():
            released(node)
        self.best = fresh

    def step(self, role: str, text: str, turn: int | None, must_go: bool, cut: bool) -> None:
        before = {s: (c, node, ()) for s, (c, node) in self.best.items()}
        self.widened(before)
        found: dict = {}
        extra = TRUNCATED if cut else 0
        for state, (cost, parent, tail) in before.items():
            self.offer(found, state, cost + DELETE, parent, (*tail, ("D", (None, None, turn))))
            if must_go:
                continue
            to = KEPT.get((state, role[:1]))
            if to is not None:
                self.offer(found, to, cost + extra, parent, (*tail, ("K", (role, text, turn))))
            to = NEXT[state]
            self.offer(found, to, cost + REROLE + extra, parent, (*tail, ("R", (ROLE[to], text, turn))))
        self.kept(found)
        self.steps += 1

    def resolved(self) -> Iterator[tuple[str, int, tuple]]:
        """The edits that all survivors share, which leave the tree."""
        if self.steps % LOOK or self.root.refs > 1:
            return
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        self.unresolved = max(self.unresolved, len(path))
        while path and self.root.refs == 1:
            node = path.pop()
            yield node.edit, node.run, node.row
            self.root, node.parent = node, None

    def finish(self) -> tuple[int, list[tuple[str, int, tuple]]]:
        """The cost of the cheapest edits, and those not yet given out."""
        found = {s: (c, node, ()) for s, (c, node) in self.best.items()}
        self.widened(found)
        last: dict = {}
        for state in (NONE, ASSISTANT):
            if state in found:
                cost, parent, tail = found[state]
                self.offer(last, NONE, cost, parent, tail)
        cost, node, tail = last[NONE]
        path = []
        while node is not self.root:
            path.append((node.edit, node.run, node.row))
            node = node.parent
        return cost, [*reversed(path), *((e, 1, row) for e, row in tail)]


def spaced(column: str) -> Column:
    """Null: one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order, with their faults: blank, seen (role and text came earlier),
    cut (its last character is none of . ! ?). Rows with a true `gone` only say that their conversation exists. One
    shuffle; the window and the last sort keep to its partitions."""
    blank = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    rows = rows.withColumns({"role": spaced("role"), "text": spaced("text")})
    rows = rows.withColumns({"blank": F.length(blank) == 0, "cut": ~F.substring(blank, -1, 1).isin(".", "!", "?")})
    place = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition(F.col("conv_id")).withColumn("seen", F.row_number().over(same) > 1)
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *place)


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, few at a time as Python values."""
    names = ["conv_id", "turn", "role", "text", "gone", "blank", "seen", "cut"]
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def edits(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Sorted rows -> ("row", conv_id, row), ("edit", conv_id, edit, run, what it leaves) and ("end", conv_id, cost), as
    far as they are final."""
    now, search = object(), None
    for row in rows:
        conv = row[0]
        if search is None or conv != now:
            if search is not None:
                yield from ended(now, search)
            now, search = conv, Search()
        if row[4]:
            yield "gone", conv, row
            continue
        yield "row", conv, row
        search.step(row[2], row[3], row[1], row[5] or row[6], row[7])
        for e in search.resolved():
            yield "edit", conv, *e
    if search is not None:
        yield from ended(now, search)


def ended(conv: int | None, search: Search) -> Iterator[tuple]:
    cost, rest = search.finish()
    for e in rest:
        yield "edit", conv, *e
    yield "end", conv, cost


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, edit, role, text): all edits of each conversation in order, a run of deletions as one row
    each; rows with a role are the repaired conversation, inserted ones without a turn."""
    rows = ordered(conversations.select(*COLUMNS, F.lit(False).alias("gone")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for e in edits(streamed(batches)):
            if e[0] == "end":
                place = 0
            elif e[0] == "edit":
                _, conv, edit, run, row = e
                for _ in range(run):
                    role, text, turn = (*row, None)[:3]
                    out.append((conv, place, turn if run == 1 else None, edit, role, text))
                    place += 1
                    if len(out) == 256:
                        yield batch(out, EDITS)
                        out = []
        if out:
            yield batch(out, EDITS)

    return rows.mapInArrow(work, EDITS)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class Summary:
    """Counts and digests of one conversation's rows and edits."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.repaired = self.turns = 0
        self.low = self.high = self.turn = self.initial = None
        self.audit, self.digest = [], hashlib.sha256()

    def row(self, row: tuple) -> None:
        _, turn, role, _, _, blank, seen, cut = row
        self.rows += 1
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn

    def edit(self, edit: str, run: int, row: tuple) -> None:
        self.audit.append(edit * run)
        if edit != "D":
            line = f"{row[0]}:{row[1]}"
            self.digest.update((f"\n{line}" if self.repaired else line).encode("utf-8", "surrogatepass"))
            self.repaired += 1

    def result(self, conv: int | None, cost: int) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest(), self.rows, self.repaired


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, what the edits cost, their initials, a digest of what they leave. A
    conversation all of whose rows are `gone` has zeros, an empty audit and the digest of the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], Summary()
        for e in edits(streamed(batches)):
            if e[0] == "row":
                now.row(e[2])
            elif e[0] == "edit":
                now.edit(*e[2:])
            elif e[0] == "end":
                out.append(now.result(e[1], e[2]))
                now = Summary()
                if len(out) == 256:
                    yield batch(out, SUMMARY)
                    out = []
        if out:
            yield batch(out, SUMMARY)

    return ordered(rows).mapInArrow(work, SUMMARY)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of `conv_id:turn` modulo 20: 0 drops a row (here: marks it as gone), 1 empties its
    text, 2 takes out . ! and ?, 3 repeats it, 4 makes it the user's."""
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "gone": F.col("kind") == 0})
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("again", F.explode(times)).select(*COLUMNS, "gone")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(damaged(table(spark, sf_dir, "conversations").select(*COLUMNS)))
