"""Typing errors: a weighted distance, words of a vocabulary for misspelt ones, and the normal form of chat questions.

The distance counts insertions, deletions, changes and swaps of neighbours as 1; a silent h and letters that sound alike in
Spanish count half. Candidates are found by deletions: letters that sound alike become one and h goes, then all strings with
as many letters left out as the distance may have whole edits are join keys of both sides, together with the sound of the
first letter (an h counts as the letter behind it, too), which must agree in any case. A distance of n leaves at most n edits
there, so the two words share a key: no candidate is lost and no word meets the whole vocabulary. Distances are worked out
where the keys meet, for a batch of pairs at once; only pairs that are near are shuffled. Words of more than `LONGEST` letters
are taken for no words and stay as they are, as do words under five letters and those with digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .scalars import plain

LONGEST = 40
# Letters that sound alike, first letters that may stand for each other, endings of conjugated forms.
ALIKE = {frozenset(p) for p in ("sc", "sz", "cz", "jg", "bv", "iy", "kc", "kq")}
FIRST = ("csz", "kcq", "bv", "gj", "iy")
ENDINGS = "amos emos imos aron ieron ando iendo aban aba ian ia aste iste ara aran era eran ira iran are ere ire aria eria iria an en ado ada ados adas ido ida idos idas".split()
FIRST_SOUND = {"c": "s", "z": "s", "k": "s", "q": "s", "v": "b", "g": "j", "y": "i"}
SOUND = str.maketrans({"c": "s", "z": "s", "k": "s", "q": "s", "g": "j", "v": "b", "y": "i", "h": None})
# What chat writes for words, and words behind which an x is a name.
SHORT = {
    "x": "por", "q": "que", "k": "que", "qe": "que", "ke": "que", "pa": "para", "d": "de", "xq": "porque", "xk": "porque", "pq": "porque", "porq": "porque", "pk": "porque",
    "tb": "también", "tmb": "también", "tbn": "también", "tambn": "también", "cant": "cantidad", "prom": "promedio",
}
KEEP_X = ["rayos", "rayo", "generacion", "tipo"]


def distance(a: str, b: str, limit: float) -> float:
    """The weighted distance, or limit + 1 if it is larger. Rows of the table that stay above the limit end the work."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    lone = [0.5 if c == "h" else 1.0 for c in b]
    above: list[float] = []
    row = [0.0]
    for cost in lone:
        row.append(row[-1] + cost)
    for i, x in enumerate(a):
        own = 0.5 if x == "h" else 1.0
        new = [row[0] + own]
        for j, y in enumerate(b):
            change = row[j] + (0.0 if x == y else 0.5 if frozenset((x, y)) in ALIKE else 1.0)
            cost = min(row[j + 1] + own, new[j] + lone[j], change)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                cost = min(cost, above[j - 1] + 1.0)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        above, row = row, new
    return row[-1] if row[-1] <= limit else limit + 1


#: Costs in halves of leaving out and of changing letters, a letter being its byte less 96 (0: behind the end).
LONE = np.full(32, 2, np.int8)
LONE[8] = 1
CHANGED = np.where(np.eye(32, dtype=bool), 0, 2).astype(np.int8)
for _pair in ALIKE:
    _x, _y = (ord(c) - 96 for c in _pair)
    CHANGED[_x, _y] = CHANGED[_y, _x] = 1


def letters(words: list[str]) -> np.ndarray:
    """A row for each place, a column for each word of a to z."""
    width = max(map(len, words))
    flat = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
    return np.ascontiguousarray((flat & 31).T)


def distances(a: list[str], b: list[str], limit: float) -> np.ndarray:
    """`distance` of many pairs of words of a to z: one row of the table after the other, for all pairs at once. As a
    letter costs a half at least, cells more than twice the limit off the diagonal are beyond it."""
    if not a:
        return np.zeros(0)
    x, y = letters(a), letters(b)
    n, m = np.array([*map(len, a)]), np.array([*map(len, b)])
    far, band = np.int8(2 * limit + 2), int(2 * limit)
    beyond, at = np.full(len(a), far, np.int8), x.astype(np.int16) * 32
    out, row = beyond.copy(), [np.zeros(len(a), np.int8)]
    for j in range(len(y)):
        row.append(np.minimum(row[-1] + LONE.take(y[j]), far))
    above = row
    for i in range(len(x) + 1):
        if i:
            own, new = LONE.take(x[i - 1]), [beyond] * (len(y) + 1)
            if i <= band:
                new[0] = np.minimum(row[0] + own, far)
            for j in range(max(1, i - band), min(len(y), i + band) + 1):
                cost = np.minimum(row[j] + own, new[j - 1] + LONE.take(y[j - 1]))
                cost = np.minimum(cost, row[j - 1] + CHANGED.take(at[i - 1] + y[j - 1]))
                if i > 1 and j > 1:
                    swap = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                    cost = np.minimum(cost, np.where(swap, above[j - 2] + np.int8(2), far))
                new[j] = np.minimum(cost, far)
            above, row = row, new
        ends = np.flatnonzero((n == i) & (abs(m - i) <= limit))
        for j in range(max(0, i - band), min(len(y), i + band) + 1):
            own = ends[m[ends] == j]
            out[own] = row[j][own]
    return np.where(out <= 2 * limit, out / 2, limit + 1)


def allowed(word: Column) -> Column:
    """How far a word may be from its correction."""
    return F.when(F.length(word) < 5, 0.0).when(F.length(word) < 8, 1.0).otherwise(2.0)


def left_out(word: str, most: int) -> list[str]:
    """The word by its sounds, and all that is left of it without up to `most` letters."""
    now = {word.translate(SOUND)}
    found = set(now)
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        found |= now
    return sorted(found)


def known_forms(word: str) -> list[str]:
    """The forms that make a word a known one: itself, its other number and its other gender."""
    base, out = word, {word}
    if word.endswith("es"):
        out.add(word[:-2])
    if word.endswith("s"):
        base = word[:-1]
        out.add(base)
    else:
        out |= {word + "s", word + "es"}
    if base[-1:] in ("o", "a"):
        other = base[:-1] + ("a" if base[-1] == "o" else "o")
        out |= {other, other + "s"}
    return sorted(out)


def alike_start(a: str, b: str) -> bool:
    silent = a[0] == "h" and a[1:2] == b[:1] or b[0] == "h" and b[1:2] == a[:1]
    return a[0] == b[0] or silent or any(a[0] in g and b[0] in g for g in FIRST)


def other_form(word: str, target: str) -> bool:
    """Whether only the ending differs, and the word has a conjugation's that the target lacks."""
    if not word.endswith(tuple(ENDINGS)):
        return False
    same = next((i for i, (x, y) in enumerate(zip(word, target, strict=False)) if x != y), min(len(word), len(target)))
    return same >= min(len(word), len(target)) - 4 and any(word.endswith(e) and not target.endswith(e) for e in ENDINGS)


def starts(word: str) -> set[str]:
    """The sounds of the first letter, one of which two words whose starts are alike have in common."""
    return {FIRST_SOUND.get(c, c) for c in (word[:2] if word[0] == "h" else word[0])}


def _keys(most: int):
    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [f"{most}{s}{k}" for s in sorted(starts(w)) for k in left_out(w, most)])

    return keys


def met(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(__w, __t) of words __w that share a key; a pair comes once for each. Words under eight letters may have one edit,
    others two; lengths differ by no more."""

    def keyed(df: DataFrame, most: int, low: int, high: int) -> DataFrame:
        return df.where(F.length("__w").between(low, high)).select("__w", F.explode(_keys(most)("__w")).alias("__k")).select("__w", F.xxhash64("__k").alias("__key"))

    mine = keyed(unknown, 1, 5, 7).union(keyed(unknown, 2, 8, LONGEST))
    theirs = keyed(known, 1, 4, 8).union(keyed(known, 2, 6, LONGEST)).withColumnRenamed("__w", "__t")
    near = F.abs(F.length("__w") - F.length("__t")) <= allowed(F.col("__w"))
    return mine.join(theirs, "__key").where(near).select("__w", "__t")


def corrections(words: DataFrame, vocabulary: DataFrame, word: str, target: str) -> DataFrame:
    """(word, correction, distance): for unknown words the one word of the vocabulary that is near; none if a second one is
    less than 0.5 farther. Both are compared folded; the correction comes as the vocabulary writes it, first by letters."""

    @F.pandas_udf("array<string>")
    def forms(words: pd.Series) -> pd.Series:
        return words.map(known_forms)

    def near_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(c.to_pylist(), object) for c in batch.columns)
            long = np.fromiter(map(len, a), int, len(a)) >= 8
            d = np.full(len(a), 3.0)
            for limit, some in ((1.0, ~long), (2.0, long)):
                d[some] = distances(a[some].tolist(), b[some].tolist(), limit)
            good = [i for i in np.flatnonzero(d <= np.where(long, 2.0, 1.0)) if alike_start(a[i], b[i]) and not other_form(a[i], b[i])]
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(d[good])], ["__w", "__t", "__d"])

    good = F.col("__w").rlike(f"^[a-z]{{1,{LONGEST}}}$")
    v = vocabulary.select(plain(F.col(target)).alias("__w"), F.col(target).alias("__as")).where(good).groupBy("__w").agg(F.min("__as").alias("__as"))
    v = written(v)
    words = words.select(word).distinct()
    asked = words.select(plain(F.col(word)).alias("__w")).where(good & (F.length("__w") >= 5)).distinct()
    known = asked.select("__w", F.explode(forms("__w")).alias("__form")).join(v.select(F.col("__w").alias("__form")), "__form", "left_semi").select("__w")
    unknown = written(asked.join(known, "__w", "left_anti"))
    near = met(unknown, v).mapInArrow(near_ones, "__w string, __t string, __d double").distinct()
    w = Window.partitionBy("__w").orderBy("__d", "__t")
    near = near.withColumns({"__r": F.row_number().over(w), "__second": F.lead("__d").over(w)})
    best = near.where((F.col("__r") == 1) & (F.col("__second").isNull() | (F.col("__second") - F.col("__d") >= 0.5)))
    found = best.join(v.select(F.col("__w").alias("__t"), "__as"), "__t")
    return words.withColumn("__w", plain(F.col(word))).join(found, "__w").select(word, F.col("__as").alias("correction"), F.col("__d").alias("distance"))


def tidy(text: Column | str) -> Column:
    """Single spaces, single signs, and a space behind a sign, not before it."""
    out = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\s ]+", " "))
    for pattern, by in ((r"([?!¿¡,;:])\1+", "$1"), (r"\.{4,}", "..."), (r"\s+([,;:?!])", "$1"), (r"([,;?!])(?=\p{L})", "$1 "), (r"([¿¡])\s+", "$1"), (r"(?i)(?<!\w)pa['’](?=\s|$)", "para")):
        out = F.regexp_replace(out, pattern, by)
    return out


def chat_words(texts: pd.Series) -> pd.Series:
    """Texts as words, signs and gaps, with letters written three times or more once, and short forms in full."""

    def full(token: str, before: str, after: str, last: str, first: bool) -> str:
        low, number = token.lower(), re.compile(r"\d+(?:[.,]\d+)*").fullmatch
        if low not in SHORT or len(token) == 1 and token.isupper() and not first:
            return token
        if low == "x" and (number(before) or number(after) or not after[:1].isalpha() or last in KEEP_X):
            return token
        if low in ("d", "k") and number(before) or low in ("d", "pa") and not after[:1].isalpha():
            return token
        return SHORT[low]

    def one(text: str) -> list[str]:
        parts = re.findall(r"\w+|[^\w\s]+|\s+", text)
        words = [i for i, p in enumerate(parts) if not p.isspace()]
        for k, i in enumerate(words):
            before, after = (parts[words[k - 1]] if k else ""), (parts[words[k + 1]] if k + 1 < len(words) else "")
            if parts[i].isalpha():
                if not re.fullmatch("[IVXLCDM]+", parts[i]):
                    parts[i] = re.sub(r"(\w)\1{2,}", r"\1", parts[i], flags=re.IGNORECASE)
                parts[i] = full(parts[i], before, after, before.lower(), k == 0 or before in ("¿", "¡", ".", "?", "!"))
        return parts

    return texts.map(one)


def normalised(questions: DataFrame, vocabulary: DataFrame, id_: str, text: str, target: str) -> DataFrame:
    """(id, text): signs, repeated letters, short forms and typing errors put right. Words in capitals, and those with a
    capital inside a sentence, are names and stay."""
    words = F.pandas_udf(chat_words, "array<string>")
    cut = questions.select(id_, tidy(text).alias("__t")).select(id_, F.posexplode_outer(words("__t")).alias("at", "token"))
    w = Window.partitionBy(id_).orderBy("at")
    sign = F.last(F.when(~F.col("token").rlike(r"^\s+$"), F.col("token")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("__before", sign)
    opens = F.col("__before").isNull() | F.col("__before").isin("¿", "¡", ".", "?", "!")
    name = (F.col("token").rlike(r"^\p{Lu}") & ~opens) | (F.col("token") == F.upper("token"))
    found = corrections(cut.where(~name), vocabulary, "token", target).select(F.col("token").alias("__is"), "correction")
    fixed = cut.join(found, (F.col("token") == F.col("__is")) & ~name, "left").select(id_, "at", F.coalesce("correction", "token").alias("token"))
    whole = fixed.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda p: p["token"]), "").alias("text"))
    return whole.withColumn("text", F.regexp_replace("text", r"(?i)(?<!\w)por\s+cada\s+(?!(?:un|uno|una|unos|unas)(?!\w))(?=\p{L})", "por "))


def words_of(texts: DataFrame, text: str) -> DataFrame:
    """(word): the folded words of texts."""
    return texts.select(F.explode(F.split(plain(F.col(text)), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
