"""N-gram Jaccard join with adaptive multi-match prefixes; links, and components of linked documents.

A document's set is its distinct word shingles (64-bit hashes). Documents with equal sets form a class, known by the
set's hash; work is done once for each class.

1. Frequencies. Tasks sort the shingles of their documents and send them, packed, to partitions of the hash space,
   where the classes that share a shingle meet. A shingle of one class only can't link anything: what goes back to a
   class is its shared shingles with their frequencies. Overlap counts need no others.
2. Prefixes. A class whose shared shingles are under the threshold has no partner. The others order shingles from rare
   to frequent. A partner shares at least ceil(t n) shingles, so among the first n - ceil(t n) + l it shares l at least.
   Each class takes the l whose estimated cost is least: reading the postings of the prefix, plus verifying the
   candidates, of which there are at most (sum of frequencies - 1) / l. Similar sets overlap in o = ceil(t (n + n') /
   (1 + t)) shingles, and all that the shorter-reaching prefix leaves out is ceil(t n) - l shingles of its set, so a
   pair must share o - max(ceil(t n) - l, ceil(t n') - l') prefix shingles, which is min(l, l') or more.
3. Candidates. In a shingle's bucket, first only pairs with one pivot are verified, which joins most of a large group
   of copies into one component. Then all pairs of different components in a bucket are counted; buckets are cut into
   blocks, so that no task holds a large bucket, and a pair whose count is reached is verified by its full overlap.
   Pairs within a component need no check, since only the components are asked for; `links` verifies all pairs.
4. Components by label propagation over verified links.

Null and empty texts have an empty set, link with nothing and are their own component. Fewer words than a shingle has
are one shingle. Rows with equal text are one class; repeated doc_ids are rows of their own; the smallest doc_id of a
component ignores nulls, and is null only if all its doc_ids are. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, WordHashes, checkpointed, merged, mixed, pack_ints, pack_sorted, parts_for, signed, slices, small_batches, table, unpack_ints, unpack_sorted, words_of, written

SHINGLE, PERCENT = 5, 75
#: Shingles that a task sorts at a time.
SORTED_TOGETHER = 1_500_000
#: Bytes of texts whose shingles one partition of the hash space holds.
BYTES_A_PART = 8 << 20
BLOCK = 512
#: Matches of pairs that a task adds up at a time.
MATCHES_HELD = 2_000_000
PIVOT_ROUNDS = 2
VERIFY_COST = 20.0


def shingle_set(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = hashes.of(words_of(text))
    if len(h) > size:
        s = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            s = s * MIX + h[k : len(h) - size + 1 + k]
    elif len(h):
        s = np.zeros(1, np.uint64)
        for x in h:
            s = s * MIX + x
    else:
        return h
    return np.unique(mixed(s))


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def pack_owners(rows: list[tuple[int | None, int, int]]) -> bytes:
    """(doc_id, size of the set, class) of rows; without a set the size is 0."""
    ids, n, sig = zip(*rows, strict=True)
    known = [x is not None for x in ids]
    return pack_ints(np.array([[x or 0 for x in ids], known, n, sig], np.int64).ravel(), "<i8")


def unpack_owners(blob: bytes) -> pd.DataFrame:
    ids, known, n, sig = unpack_ints(blob, "<i8").reshape(4, -1)
    return pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").where(known > 0), "n": n, "sig": pd.Series(sig).astype("Int64").where(n > 0)})


def postings(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Packed (part, shingles, owner, sigs, ns): each shingle with the number of its class in the lists sigs and ns.
    Rows with `docs` hold the class of each document instead, so that texts are read and hashed once."""
    together = SORTED_TOGETHER
    fields = {"shingles": pa.binary(), "owner": pa.binary(), "sigs": pa.binary(), "ns": pa.binary(), "docs": pa.binary()}

    def packed(part: int, **values: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([values.get(k)], t) for k, t in fields.items())], ["part", *fields])

    def flush(sets: dict[int, np.ndarray], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        blob = pack_owners(rows)
        yield packed(zlib.crc32(blob) % parts, docs=blob)
        if not sets:
            return
        sigs, ns = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
        all_, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(ns), dtype=np.uint32), ns)
        order = np.argsort(all_, kind="stable")
        all_, owner = all_[order], owner[order]
        bounds = np.searchsorted(all_, (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)) if parts > 1 else np.array([], int)
        for part, (h, o) in enumerate(zip(np.split(all_, bounds), np.split(owner, bounds), strict=True)):
            if len(h):
                used, local = np.unique(o, return_inverse=True)
                yield packed(part, shingles=pack_sorted(h), owner=pack_ints(local), sigs=sigs[used].tobytes(), ns=pack_ints(ns[used]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, rows, held = WordHashes(200_000), {}, [], 0
        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingle_set(text, hashes, size)
                sig = class_of(s) if len(s) else 0
                rows.append((doc_id, len(s), sig))
                held += 1
                if len(s) and sig not in sets:
                    sets[sig] = s
                    held += len(s)
                if held >= together:
                    yield from flush(sets, rows)
                    sets, rows, held = {}, [], 0
        if rows:
            yield from flush(sets, rows)

    out = "part int, shingles binary, owner binary, sigs binary, ns binary, docs binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, out)


def shared(packed: DataFrame, groups: int) -> DataFrame:
    """Packed (grp, sig, n, shingle, df) arrays of the shingles that two classes or more share, by group of classes;
    rows with `docs` pass through."""
    columns = ["grp", "sig", "n", "shingle", "df", "docs"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        through = [(zlib.crc32(x) % groups, None, None, None, None, x) for x in pdf["docs"].dropna()]
        pdf = pdf[pdf["docs"].isna()]
        return pd.DataFrame(through + (kept(pdf) if len(pdf) else []), columns=columns)

    def kept(pdf: pd.DataFrame) -> list[tuple]:
        h = np.concatenate([unpack_sorted(x) for x in pdf["shingles"]])
        sigs = [np.frombuffer(x, np.int64) for x in pdf["sigs"]]
        own = [unpack_ints(x) for x in pdf["owner"]]
        sig = np.concatenate([s[o] for s, o in zip(sigs, own, strict=True)])
        n = np.concatenate([unpack_ints(x)[o] for x, o in zip(pdf["ns"], own, strict=True)])
        order = np.lexsort((sig, h))
        h, sig, n = h[order], sig[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig, n = h[new], sig[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(start, len(h)))
        df = np.repeat(df, df)
        keep = df > 1
        h, sig, n, df = h[keep], sig[keep], n[keep], df[keep]
        grp = (mixed(sig.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((h, sig, grp))
        h, sig, n, df, grp = (x[order] for x in (h, sig, n, df, grp))
        cuts = np.flatnonzero(np.diff(grp)) + 1 if len(grp) else np.array([], int)
        return [(int(g[0]), pack_ints(s, "<u8"), pack_ints(m), pack_ints(x, "<u8"), pack_ints(d), None) for g, s, m, x, d in zip(*(np.split(x, cuts) for x in (grp, sig, n, h, df)), strict=True) if len(g)]

    return packed.groupBy("part").applyInPandas(meet, "grp int, sig binary, n binary, shingle binary, df binary, docs binary")


def prefix(h: np.ndarray, df: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, int]:
    """The shared shingles in the prefix, rare first, and the number of matches asked for."""
    order = np.lexsort((h, df))
    h, df = h[order], df[order]
    alone = n - len(h)  # shingles of this class only stand first
    need = required(n, percent)
    matches = np.arange(1, need + 1)
    reach = n - need + matches - alone
    read = np.cumsum(df - 1)[reach - 1].astype(float)
    least = int(np.argmin(read + VERIFY_COST * read / matches)) + 1
    return h[: reach[least - 1]], least


def required(n, percent: int):
    """Shingles of a set that a partner must have."""
    return -(-percent * n // 100)


def candidates(shared_: DataFrame, percent: int) -> DataFrame:
    """(sig, n, least, prefix, shingles) of the classes that can have a partner, and (doc_id, n, sig) of all documents,
    whose `least` is null and whose sig is null for an empty set."""
    columns = ["sig", "n", "least", "prefix", "shingles"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [unpack_owners(x) for x in pdf["docs"].dropna()]
        pdf = pdf[pdf["docs"].isna()]
        sets = pd.DataFrame(fitting(pdf) if len(pdf) else [], columns=columns)
        out = pd.concat([sets.astype({"sig": "Int64", "n": "Int64", "least": "Int32"}), *docs]).reindex(columns=[*columns, "doc_id"])
        lists = out[["prefix", "shingles"]].astype(object)
        return out.assign(**lists.where(lists.notna(), None))

    def fitting(pdf: pd.DataFrame) -> list[tuple]:
        sig = np.concatenate([unpack_ints(x, "<u8") for x in pdf["sig"]]).view(np.int64)
        n, df = (np.concatenate([unpack_ints(x) for x in pdf[c]]).astype(np.int64) for c in ("n", "df"))
        h = np.concatenate([unpack_ints(x, "<u8") for x in pdf["shingle"]])
        order = np.lexsort((h, sig))
        sig, n, h, df = sig[order], n[order], h[order], df[order]
        cuts = np.flatnonzero(np.diff(sig)) + 1
        rows = []
        for s, m, x, d in zip(*(np.split(v, cuts) for v in (sig, n, h, df)), strict=True):
            if 100 * len(x) >= percent * m[0]:
                first, least = prefix(x, d, int(m[0]), percent)
                rows.append((int(s[0]), int(m[0]), least, signed(first).tolist(), x.astype("<u8").tobytes()))
        return rows

    return shared_.groupBy("grp").applyInPandas(choose, "sig long, n long, least int, prefix array<long>, shingles binary, doc_id long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of distinct pairs, of fitting sizes, whose Jaccard similarity reaches the threshold."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True):
                both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (nx + ny - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb", "na", "nb").mapInArrow(overlap, "a long, b long")


def labelled(entries: DataFrame, comp: DataFrame | None, round_: int = 0) -> DataFrame:
    """The entries with the component of their class so far and its size, of those buckets that have more than one; with
    the bucket's pivot, number of entries and first class by hash. What a bucket has in common is a written table, so
    that large buckets can be split where it is joined."""
    if comp is None:
        e = entries.withColumn("comp", F.col("sig")).withColumn("weight", F.lit(1).cast("long"))
    else:
        weight = written(comp.groupBy("component").agg(F.count("*").alias("w")))
        comp = comp.join(weight, "component").select(F.col("node").alias("sig"), "component", "w")
        e = entries.join(comp, "sig", "left").withColumn("comp", F.coalesce("component", "sig")).withColumn("weight", F.coalesce("w", F.lit(1))).drop("component", "w")
    e = checkpointed(e)
    pivot = F.min(F.struct(F.xxhash64("sig", F.lit(round_)), "sig", "comp", "n")).alias("pivot")
    buckets = e.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), pivot, F.count("*").alias("size"), F.min(F.xxhash64("sig")).alias("mate"))
    return e.join(written(buckets.where("low < high").drop("low", "high")), "token")


def pivot_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """In each bucket, the pairs of one member with those of other components, where the sizes fit."""
    fits = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    return entries.where(fits & F.expr("comp <> pivot.comp")).select(F.col("pivot.sig").alias("a"), F.col("sig").alias("b")).distinct()


def counted_pairs(entries: DataFrame, percent: int, within: bool) -> DataFrame:
    """Pairs that share enough prefix shingles; of different components, or all if within. Large buckets are cut into
    blocks by the hash of the class, and each two blocks meet in a row of their own. Buckets whose first class by hash
    is the same have much the same members: they meet in one task, which adds up their matches before they move."""
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / BLOCK)))
    e = entries.withColumn("one", F.struct("weight", "comp", "sig", "n", "least")).withColumn("blocks", F.pow(F.lit(2), halvings).cast("int"))
    e = e.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).repartition("token", "block")
    blocks = e.groupBy("token", "block", "blocks", "mate").agg(F.collect_list("one").alias("members"))
    first = blocks.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    met = first.join(blocks.select("token", F.col("block").alias("other"), F.col("members").alias("others")), ["token", "other"])
    met = met.repartition("mate", "block", "other").select("members", F.when(F.col("block") == F.col("other"), F.lit(None)).otherwise(F.col("others")).alias("others"))

    def summed(held: list[tuple]) -> pa.RecordBatch:
        """(a, packed partners, matches seen and asked) of the matches held."""
        a = np.repeat(np.array([r[0] for r in held], np.int64), [len(r[1]) for r in held])
        b, asked = (np.concatenate([r[k] for r in held]) for k in (1, 2))
        order = np.lexsort((b, a))
        a, b, asked = a[order], b[order], asked[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        seen = np.diff(np.append(at, len(a))).astype(np.int32)
        a, b, asked = a[at], b[at], asked[at]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        packed = [pa.array([x.tobytes() for x in np.split(v, start[1:])], pa.binary()) for v in (b, seen, asked)]
        return pa.RecordBatch.from_arrays([pa.array(a[start]), *packed], ["a", "others", "seen", "asked"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("weight", "comp", "sig", "n", "least")
        read = lambda rows: [np.array([r[f] for r in rows], np.int64) for f in fields]
        held, size = [], 0
        for batch in batches:
            for rows, others in zip(batch.column("members"), batch.column("others"), strict=True):
                x = read(rows.as_py())
                y = read(others.as_py()) if others.is_valid else x
                for ones, many in ((x, y), (y, x)) if others.is_valid else ((x, y),):
                    weights, comps, sigs, sizes_, leasts = many
                    rest = required(sizes_, percent) - leasts
                    for w, c, s, n, least in zip(*ones, strict=True):  # from the smaller component to the larger one
                        ok = sigs > s if within else (weights > w) | ((weights == w) & (comps > c))
                        ok &= 100 * np.minimum(n, sizes_) >= percent * np.maximum(n, sizes_)
                        if ok.any():
                            overlap = -(-percent * (n + sizes_[ok]) // (100 + percent))
                            asked = overlap - np.maximum(rest[ok], required(n, percent) - least)
                            held.append((s, sigs[ok], asked.astype(np.int32)))
                            size += len(asked)
                if size >= MATCHES_HELD:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["others"]])
        seen, asked = (np.concatenate([np.frombuffer(x, np.int32) for x in pdf[c]]) for c in ("seen", "asked"))
        b, at, to = np.unique(b, return_index=True, return_inverse=True)
        b = b[np.bincount(to, seen) >= asked[at]]
        return pd.DataFrame({"a": np.full(len(b), pdf["a"].iloc[0]), "b": b})

    packed = met.mapInArrow(pair, "a long, others binary, seen binary, asked binary")
    return packed.groupBy("a").applyInPandas(count, "a long, b long")


def prepared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, sets, entries): the class of each document, the classes that can have partners, and their prefix shingles."""
    parts = parts_for(docs, BYTES_A_PART)
    with small_batches(docs.sparkSession):
        both = checkpointed(candidates(shared(postings(docs, size, parts), parts), percent))
    own, sets = both.where("least is null").select("doc_id", "n", "sig"), both.where("least is not null")
    return own, sets.select("sig", "n", "shingles"), sets.select("sig", "n", "least", F.explode("prefix").alias("token"))


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All links (a, b) between classes, and so one row for each two different sets that are similar."""
    _, sets, entries = prepared(docs, size, percent)
    return verified(counted_pairs(labelled(entries, None), percent, True), sets, percent)


def joined(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    own, sets, entries = prepared(docs, size, percent)
    comp = None
    for r in range(PIVOT_ROUNDS + 1):
        e = labelled(entries, comp, r)
        pairs = pivot_pairs(e, percent) if r < PIVOT_ROUNDS else counted_pairs(e, percent, False)
        comp = merged(comp, checkpointed(verified(pairs, sets, percent)))
    smallest = own.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"))
    root = smallest.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("component", "sig"))
    root = checkpointed(root.select("sig", "first", "root"))
    ids = written(root.groupBy("root").agg(F.min("first").alias("component_id")))
    by_class = root.select("sig", "root").join(ids, "root").select("sig", "component_id")
    some = own.where("sig is not null").join(by_class, "sig")
    none = own.where("sig is null").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(none.select("doc_id", "n", "component_id"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, rows without doc_id last; of equal ones, one.
    Rows are told apart by a 64-bit hash of doc_id and text, so null and repeated ids with different texts are
    documents of their own."""
    rows = docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    of_row = joined(rows.select(F.col("__key").alias("doc_id"), "text"))
    of_key = written(of_row.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("m")
    first = written(rows.select("__key", "doc_id").distinct().join(of_key, "__key").groupBy("component_id").agg(best).select(F.col("m.__key").alias("__key")))
    # The keys that go, and those that stay and are repeated, are few as a rule: whole texts move only where they are many.
    gone = written(of_key.join(first, "__key", "left_anti").select("__key"))
    repeated = written(of_key.where("rows > 1").join(first, "__key", "left_semi").select("__key"))
    once = rows.join(gone, "__key", "left_anti").join(repeated, "__key", "left_anti").select(*docs.columns)
    w = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns)))
    return once.union(rows.join(repeated, "__key", "left_semi").withColumn("__row", w).where(F.expr("__row = 1")).select(*docs.columns))
