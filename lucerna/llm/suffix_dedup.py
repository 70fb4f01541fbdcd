"""Removal of repeated byte strings, exactly, by suffix arrays of shards.

Each byte is removed that lies in a string of LENGTH bytes which also starts anywhere else. Strings don't cross texts.

Shards. A window of LENGTH bytes has an anchor: its GRAM-byte string of least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so windows meet if they are dealt by their anchor. Texts are known by a
64-bit hash of their bytes and worked on once; a text that occurs twice goes as a whole. Tasks send the anchors of their
texts, packed; only those that occur at two places or more come back to the text, which then cuts a segment around
each: the windows with this anchor, in one piece. Segments of an anchor with very many occurrences are cut at fixed
distances from the anchor and dealt by the hash of what the windows of a piece have in common. Equal segments are sent
once, with the number of their occurrences.

Suffix arrays. A shard's segments, one after the other, are sorted by induced sorting: suffixes are classified as
smaller or larger than the next, the leftmost smaller ones are sorted by their substrings, recursively where these are
not distinct, and all others are induced from them, bucket by bucket. A window is repeated if the permuted common
prefix with its neighbour in the array reaches LENGTH, or if its segment occurs twice.

Null texts are empty. Texts under LENGTH bytes keep all. Repeated rows are texts that occur twice; a null doc_id is kept
as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, mixed, pack_ints, pack_sorted, parts_for, slices, table, unpack_ints, unpack_sorted, written

LENGTH, GRAM = 200, 32
#: Bytes whose anchors a task finds at a time, and anchors that it sends at a time.
SCANNED_TOGETHER, SENT_TOGETHER = 2 << 20, 400_000
#: Occurrences of an anchor from which its segments are cut into pieces of PIECE windows.
HOT, PIECE = 256, 16
SCALAR_ALPHABET = 2048
#: Bytes of texts whose repeated anchors one shard gets.
BYTES_A_SHARD = 8 << 20


# --- suffix arrays


def types_of(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. s ends in a 0 that is nowhere else."""
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(len(s), bool)
    small[:-1] = np.append(step, 1)[following] > 0
    return small


def dealt(values: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends values to the buckets of their characters, in order."""
    if len(values):
        order = np.argsort(chars, kind="stable")
        values, chars = values[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for c, v in zip(chars[np.concatenate([[0], cuts])], np.split(values, cuts), strict=True):
            into[c].append(v)


def induced_by_bucket(s: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost smaller suffixes in order; whole buckets at a time, rounds within a bucket
    follow runs of its character."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    dealt(lms, s[lms], seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    none = np.zeros(0, np.int64)

    def before(positions: np.ndarray, kind: bool) -> np.ndarray:
        p = positions[positions > 0] - 1
        return p[small[p] == kind]

    for c in range(k):
        now, done = np.concatenate(large[c] or [none]), []
        while len(now):
            done.append(now)
            p = before(now, False)
            same = s[p] == c
            dealt(p[~same], s[p[~same]], large)
            now = p[same]
        large[c] = [np.concatenate(done or [none])]
        p = before(np.concatenate(seeds[c] or [none]), False)
        dealt(p, s[p], large)
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]  # from the largest down
    for c in range(k - 1, -1, -1):
        now, done = np.concatenate(smaller[c] or [none]), []
        while len(now):
            done.append(now)
            p = before(now, True)
            same = s[p] == c
            dealt(p[~same], s[p[~same]], smaller)
            now = p[same]
        smaller[c] = [np.concatenate(done or [none])]
        p = before(large[c][0][::-1], True)
        dealt(p, s[p], smaller)
    smaller[0] = [np.array([len(s) - 1])]
    return np.concatenate([x for c in range(k) for x in (large[c][0], smaller[c][0][::-1])])


def induced_one_by_one(s: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """The same for large alphabets, where buckets hold few suffixes each. Places not yet filled hold 0, before which
    nothing stands."""
    ends = np.cumsum(np.bincount(s, minlength=k))
    out = [0] * len(s)
    tails = ends.tolist()
    for p, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        tails[c] -= 1
        out[tails[c]] = p
    # of the suffix before each one: its character if it is of the kind that is induced, else -1
    heads, large = (ends - np.bincount(s, minlength=k)).tolist(), np.append(-1, np.where(small, -1, s)[:-1]).tolist()
    for p in out:
        c = large[p]
        if c >= 0:
            out[heads[c]] = p - 1
            heads[c] += 1
    tails, smaller = ends.tolist(), np.append(-1, np.where(small, s, -1)[:-1]).tolist()
    for p in reversed(out):
        c = smaller[p]
        if c >= 0:
            tails[c] -= 1
            out[tails[c]] = p - 1
    out[0] = len(s) - 1
    return np.array(out, np.int64)


def named(s: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """The leftmost smaller substrings' ranks, equal ones alike. Characters with their suffix's kind are compared, as
    many at a time as fit an integer: of two that agree up to the end of one, the other's last is of the larger kind."""
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    signs = 2 * s + small + 1
    bits = int(2 * k + 1).bit_length()
    wide, at = 62 // bits, 0
    rank, live = np.zeros(len(lms), np.int64), np.arange(len(lms))
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(at, at + wide):
            more = j < size[live]
            key = (key << bits) | np.where(more, signs[np.where(more, lms[live] + j, 0)], 0)
        order = np.lexsort((key, rank[live])) if at else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        was = rank[live]
        group = np.concatenate([[True], was[1:] != was[:-1]])
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        place = np.arange(len(live))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[live] = was + first - np.maximum.accumulate(np.where(group, place, 0))
        at += wide
        alone = new & np.append(new[1:], True)
        live = live[~alone & (size[live] > at)]
    return rank


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """s: integers under k, of which only the last is 0."""
    s = s.astype(np.int64)
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = types_of(s)
    first = np.zeros(len(s), bool)
    first[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(first)
    distinct, names = np.unique(named(s, small, k, lms), return_inverse=True)
    order = np.argsort(names) if len(distinct) == len(lms) else suffix_array(names, len(distinct))
    induced = induced_by_bucket if k <= SCALAR_ALPHABET else induced_one_by_one
    return induced(s, small, k, lms[order])


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: of each position, with the suffix before it in the array. Where the characters before
    both agree it is one less than at the position before; only at the others texts are compared."""
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    anew = np.ones(n, bool)
    anew[1:] = (phi[1:] < 1) | (data[:-1] != data[phi[1:] - 1])
    padded = np.concatenate([data.astype(np.uint64), np.zeros(4, np.uint64)])
    four = padded[:-3] | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(32)) | (padded[3:] << np.uint64(48))
    out = np.zeros(n, np.int64)
    live, at = np.flatnonzero(anew & (phi >= 0)), 0
    while len(live):
        a, b = live + at, phi[live] + at
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        differ = four[a] ^ four[b]
        ended = differ != 0
        out[live[ended]] = at + (((differ & (~differ + np.uint64(1)))[ended] >= np.uint64([[1 << 16], [1 << 32], [1 << 48]])).sum(0))
        out[live[~ended]] = at + 4
        live, at = live[~ended], at + 4
    since = np.maximum.accumulate(np.where(anew, place, 0))
    return out[since] - (place - since)


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some distinct segments: which of its windows occur elsewhere in them or in itself."""
    sizes = np.array([len(x) for x in segments])
    data = np.frombuffer(b"\0".join(segments), np.uint8).astype(np.int64) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    data[starts[1:] - 1] = 1
    sa = suffix_array(np.append(data, 0), 258)
    prefix = common_prefixes(np.append(data, 0), sa)
    hit = prefix >= length
    before = np.full(len(sa), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    hit[before[np.flatnonzero(prefix >= length)]] = True
    return [hit[a : a + n - length + 1] for a, n in zip(starts, sizes, strict=True)]


# --- anchors


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, first window, windows, anchor's place) of each anchor; texts of length bytes at least."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    h = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    power, step = MIX, 1
    while step < gram:
        h = h[:-step] * power + h[step:]
        power, step = power * power, step * 2
    h = mixed(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    chosen = least[starts[owner] + first]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    place = (chosen[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h[place], owner[at], first[at], np.diff(np.append(at, len(chosen))), place - starts[owner[at]]


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def key_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def sent_anchors(docs: DataFrame, parts: int) -> DataFrame:
    scanned, sent_ = SCANNED_TOGETHER, SENT_TOGETHER

    def flush(found: list[tuple], keys: list[int]) -> Iterator[pa.RecordBatch]:
        h, owner, first, n, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, owner, first, n, place = (x[order] for x in (h, owner, first, n, place))
        names = np.array(keys, np.int64)
        bounds = np.searchsorted(h, (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)) if parts > 1 else np.array([], int)
        for part, (x, *rest) in enumerate(zip(*(np.split(v, bounds) for v in (h, owner, first, n, place)), strict=True)):
            if len(x):
                used, local = np.unique(rest[0], return_inverse=True)
                row = (pack_sorted(x), names[used].tobytes(), pack_ints(local), *map(pack_ints, rest[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v], pa.binary()) for v in row)], ["part", "hash", "texts", "owner", "first", "n", "place"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found, keys, texts, held, n = [], [], [], 0, 0
        for b in slices(batches):
            for data in map(raw, b.column("text").to_pylist()):
                if len(data) >= LENGTH and (key := key_of(data)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(data)
                    held += len(data)
                if held >= scanned:
                    h, owner, *rest = anchors(texts)
                    found.append((h, owner + len(keys) - len(texts), *rest))
                    n += len(h)
                    texts, held = [], 0
                    if n >= sent_:
                        yield from flush(found, keys)
                        found, keys, n = [], [], 0
        if texts:
            h, owner, *rest = anchors(texts)
            found.append((h, owner + len(keys) - len(texts), *rest))
        if found:
            yield from flush(found, keys)

    return docs.select("text").mapInArrow(send, "part int, hash binary, texts binary, owner binary, first binary, n binary, place binary")


def repeated_anchors(sent: DataFrame, groups: int) -> DataFrame:
    """Packed (grp, key, hash, first, n, place, hot) of the anchors that occur at two places or more."""
    many = HOT

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([unpack_sorted(x) for x in pdf["hash"]])
        key = np.concatenate([np.frombuffer(t, np.int64)[unpack_ints(o)] for t, o in zip(pdf["texts"], pdf["owner"], strict=True)])
        first, n, place = (np.concatenate([unpack_ints(x) for x in pdf[c]]) for c in ("first", "n", "place"))
        order = np.lexsort((first, key, h))
        h, key, first, n, place = (x[order] for x in (h, key, first, n, place))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (first[1:] != first[:-1])
        h, key, first, n, place = (x[new] for x in (h, key, first, n, place))
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(start, len(h)))
        times = np.repeat(times, times)
        keep = times > 1
        h, key, first, n, place, times = (x[keep] for x in (h, key, first, n, place, times))
        grp = group_of(key, groups)
        order = np.argsort(grp, kind="stable")
        cuts = np.flatnonzero(np.diff(grp[order])) + 1
        columns = [np.split(x[order], cuts) for x in (grp, key, h, first, n, place, times > many)]
        rows = [(int(g[0]), k.tobytes(), pack_ints(x, "<u8"), *map(pack_ints, rest)) for g, k, x, *rest in zip(*columns, strict=True) if len(g)]
        return pd.DataFrame(rows, columns=["grp", "key", "hash", "first", "n", "place", "hot"])

    return sent.groupBy("part").applyInPandas(meet, "grp int, key binary, hash binary, first binary, n binary, place binary, hot binary")


# --- segments


def texts_by_group(docs: DataFrame, groups: int) -> DataFrame:
    """(grp, key, data) of each distinct text, once for each task."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            rows = []
            for data in map(raw, b.column("text").to_pylist()):
                if len(data) >= LENGTH and (key := key_of(data)) not in seen:
                    seen.add(key)
                    rows.append((key, data))
            keys = np.array([k for k, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group_of(keys, groups), pa.int32()), pa.array(keys), pa.array([d for _, d in rows], pa.binary())], ["grp", "key", "data"])

    return docs.select("text").mapInArrow(send, "grp int, key long, data binary")


def segments(texts: DataFrame, repeated: DataFrame, shards: int) -> DataFrame:
    """Kind t: (key, data) of texts with repeated anchors. Kind s: (name, shard, anchor, data, times) of distinct segments,
    with places (key, first window) at which they stand, all by group of texts."""

    def cut(own: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(own) and len(info):
            data = dict(zip(own["key"], own["data"], strict=True))
            grp = int(own["grp"].iloc[0])
            key = np.concatenate([np.frombuffer(x, np.int64) for x in info["key"]]).tolist()
            h = np.concatenate([unpack_ints(x, "<u8") for x in info["hash"]]).tolist()
            first, n, place, hot = (np.concatenate([unpack_ints(x) for x in info[c]]).tolist() for c in ("first", "n", "place", "hot"))
            found: dict[bytes, tuple[int, list[int], list[int]]] = {}
            for k, x, f, m, p, many in zip(key, h, first, n, place, hot, strict=True):
                text = data[k]
                if not many:
                    entry = found.setdefault(text[f : f + m - 1 + LENGTH], (x - (1 << 63), [], []))
                    entry[1].append(k)
                    entry[2].append(f)
                    continue
                # by distance to the anchor in blocks: equal windows are in equal blocks, and share the block's inner part
                for block in range((p - f - m + 1) // PIECE, (p - f) // PIECE + 1):
                    low, high = max(f, p - block * PIECE - PIECE + 1), min(f + m, p - block * PIECE + 1)
                    inner = text[p - block * PIECE : p - block * PIECE - PIECE + 1 + LENGTH]
                    entry = found.setdefault(text[low : high - 1 + LENGTH], (key_of(inner), [], []))
                    entry[1].append(k)
                    entry[2].append(low)
            rows += [(grp, "t", k, -1, 0, data[k], 0, None, None) for k in dict.fromkeys(key)]
            rows += [(grp, "s", key_of(x), a % shards, a, x, len(k), np.array(k, np.int64).tobytes(), pack_ints(np.array(f))) for x, (a, k, f) in found.items()]
        return pd.DataFrame(rows, columns=["grp", "kind", "key", "shard", "anchor", "data", "times", "keys", "firsts"])

    schema = "grp int, kind string, key long, shard int, anchor long, data binary, times long, keys binary, firsts binary"
    return texts.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInPandas(cut, schema)


def searched(distinct: DataFrame) -> DataFrame:
    """(name, ranges) of the segments that hold repeated windows: byte ranges [from, to) from the segment's start."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        # Equal windows have equal anchors: a segment that stands once is compared with the others of its anchor, and
        # segments that all stand twice or more are repeated throughout.
        of_anchor = pdf.groupby("anchor")["times"].agg(["size", "min"]).loc[pdf["anchor"]]
        sort = ((of_anchor["size"] > 1) & (of_anchor["min"] < 2)).to_numpy()
        data = pdf["data"].tolist()
        hits = [np.full(len(x) - LENGTH + 1, t > 1) for x, t in zip(data, pdf["times"], strict=True)]
        if sort.any():
            at = np.flatnonzero(sort)
            for i, hit in zip(at, repeated_windows([data[i] for i in at]), strict=True):
                hits[i] = hits[i] | hit
        for name, hit in zip(pdf["key"], hits, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            if len(edge):
                ranges = edge.reshape(-1, 2)
                rows.append((int(name), np.stack([ranges[:, 0], ranges[:, 1] - 1 + LENGTH], 1).astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["key", "ranges"])

    return distinct.groupBy("shard").applyInPandas(search, "key long, ranges binary")


def cleaned(cut: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256) of the texts with repeated anchors."""

    def clean(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        spans: dict[int, list[np.ndarray]] = {}
        for keys, firsts, ranges_ in zip(found["keys"], found["firsts"], found["ranges"], strict=True):
            r = np.frombuffer(ranges_, "<u4").astype(np.int64).reshape(-1, 2)
            for k, f in zip(np.frombuffer(keys, np.int64).tolist(), unpack_ints(firsts).tolist(), strict=True):
                spans.setdefault(k, []).append(r + f)
        rows = []
        for k, data in zip(texts["key"], texts["data"], strict=True):
            if k in spans:
                edge = np.zeros(len(data) + 1, np.int64)
                r = np.concatenate(spans[k])
                np.add.at(edge, r[:, 0], 1)
                np.add.at(edge, r[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((k, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = cut.where("kind = 't'").select("grp", "key", "data")
    at = cut.where("kind = 's'").select(F.col("grp").alias("g"), F.col("key").alias("name"), "keys", "firsts")
    met = at.join(ranges.withColumnRenamed("key", "name"), "name").select("g", "keys", "firsts", "ranges")
    return texts.groupBy("grp").cogroup(met.groupBy("g")).applyInPandas(clean, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def rows_of(docs: DataFrame) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [raw(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([key_of(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "key", "n_bytes", "whole"])

    return docs.select("doc_id", "text").mapInArrow(name, "doc_id long, key long, n_bytes long, whole string")


def repeats(docs: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) of each text that occurs once and has repeated strings."""
    parts = parts_for(docs, BYTES_A_SHARD)
    cut = written(segments(texts_by_group(docs, parts), repeated_anchors(sent_anchors(docs, parts), parts), parts))
    # a name stands for one content: its shard is the content's
    own = cut.where("kind = 's'").groupBy("key").agg(F.sum("times").alias("times"), F.min("shard").alias("shard"), F.min("anchor").alias("anchor"), F.min("data").alias("data"))
    return cleaned(cut, searched(own))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    rows = written(rows_of(docs))
    long = rows.where(F.col("n_bytes") >= LENGTH)
    copies = long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("whole_gone"))
    info = written(repeats(docs).drop("kept").join(copies, "key", "full"))
    gone = F.coalesce("whole_gone", F.lit(False))
    known = long.join(info, "key", "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
    none = F.lit(0).cast("long")
    short = rows.where(F.col("n_bytes") < LENGTH).select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("whole").alias("kept_sha256"))
    return known.union(short)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
