"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document has counts (words, symbols, repeated lines and words). A base rule rejects short and repetitive texts.
Beyond it, four measures have a grid of cutoffs. Labelled documents that pass the base rule test them in each stratum,
in a fixed sequence: the measure whose first cutoff rejects most bad documents goes from the most lenient cutoff to the
strictest, then the next measure beside it, and so on. A step takes the most lenient cutoff that rejects as many bad
documents as its own (none, if that rejects no bad one). With n good documents of which the measures so far reject k
together, the step is certified if the exact binomial tail P(Bin(n, risk) <= k) is at most error / strata and all steps
before it are certified; the last certified step is taken. So a measure that fails stops those behind it.
The steps depend on the bad documents alone, and a fixed sequence needs no correction for its length: in all strata
together the measures reject more than risk of the good documents with probability error at most. Without a certified
step nothing is rejected in that stratum; with four strata, 436 good documents of which none is rejected certify one.

Null and empty texts have no words and fail the base rule. A null stratum is a stratum of its own. Labels without a
document, null labels and an empty label table certify nothing. Repeated rows give repeated results; repeated labels
of a document count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, written

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
#: measure -> (first cutoff, step); a document is rejected if its measure is above the cutoff.
GRID = {"symbol_ratio": (0.02, 0.02), "dup_line_ratio": (0.05, 0.05), "repeat_ratio": (0.05, 0.05), "word_length": (6.0, 0.5)}
CUTOFFS = 20
RISK, ERROR = 0.01, 0.05


def repeated_words(words: Column, hashes: Column) -> Column:
    """Positions in 3-word windows that occur twice or more. Windows without an equal hash need no look at their words."""

    def marked(s: Column) -> Column:
        near = lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])
        starts = F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(near(x, j), x["i"])), lambda x: x.isNotNull()))
        step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    window = lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("i"))
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), window))
    counted = F.element_at(F.transform(F.array(windows), marked), 1)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted)


def measured(docs: DataFrame) -> DataFrame:
    """The documents with their counts and the number of grid cutoffs that each measure exceeds (q_...)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("q_text", text)
    d = d.withColumn("q_words", F.filter(F.split("q_text", BLANK_RE + "+"), lambda w: w != ""))
    three = lambda i: F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2))
    at = F.when(F.size("q_words") > 2, F.sequence(F.lit(0), F.size("q_words") - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("q_hashes", F.transform(at, three))
    d = d.withColumn("q_lines", F.filter(F.split("q_text", "\n", -1), lambda s: F.length(F.translate(s, BLANK, "")) > 0))
    d = d.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.length(F.translate("q_text", BLANK, "")).cast("long"),
        "n_symbols": (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("q_words"), F.col("q_hashes")).cast("long"),
        "q_n_lines": F.size("q_lines"),
    })
    d = d.drop("q_text", "q_words", "q_hashes", "q_lines")
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = {"symbol_ratio": over("n_symbols", "word_chars"), "dup_line_ratio": over("n_dup_lines", "q_n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}
    above = lambda v, first, step: F.greatest(F.lit(0), F.least(F.lit(CUTOFFS), F.ceil((v - first) / step))).cast("int")
    d = d.withColumns({f"q_{k}": above(v, *GRID[k]) for k, v in values.items()})
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("q_n_lines")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), by summing the terms in logarithms."""
    k, n = k.cast("double"), n.cast("double")
    first = n * F.log1p(F.lit(-p))
    odds = p / (1 - p)

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        return F.struct(term.alias("term"), (F.greatest(acc["sum"], term) + F.log1p(F.exp(-F.abs(acc["sum"] - term)))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])


def certified_cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, c_<measure>...): the index of the chosen cutoff of each measure, null if none is certified."""
    held = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    m = measures.where("not base_failed").select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *(f"q_{k}" for k in GRID)).join(held, "doc_id")
    m = checkpointed(m)
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(f"q_{k}").alias("bin")) for k in GRID)))
    counts = m.where("quality = 0").select("stratum", bins.alias("b")).groupBy("stratum", "b.measure", "b.bin").agg(F.count("*").alias("bad"))
    c = counts.where("bin > 0").groupBy("stratum", "measure").agg(F.sum("bad").alias("hits"), F.collect_set("bin").alias("bins"))  # CUTOFFS at most
    # the most lenient cutoff with a step's hits: the least bin beyond the step that holds a bad document, less one
    cuts = F.transform(F.sequence(F.lit(0), F.lit(CUTOFFS - 1)), lambda t: F.array_min(F.filter("bins", lambda b: b > t)) - 1)
    place = F.array_position(F.array(*map(F.lit, GRID)), F.col("measure"))
    c = c.withColumn("cuts", cuts).withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("hits"), place)) - 1)
    c = c.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) * CUTOFFS - 1)))).withColumn("turn", F.floor(F.col("step") / CUTOFFS))
    cutoff = F.when(F.col("rank") < F.col("turn"), F.get("cuts", F.lit(0))).when(F.col("rank") == F.col("turn"), F.get("cuts", CUTOFFS - 1 - F.col("step") % CUTOFFS))
    steps = c.withColumn("cutoff", cutoff).groupBy("stratum", "step").agg(*(F.max(F.when(F.col("measure") == k, F.col("cutoff"))).alias(f"c_{k}") for k in GRID))
    strata = m.select("stratum").distinct().count()
    rejected = F.greatest(*(F.coalesce((F.col(f"q_{k}") > F.col(f"c_{k}")).cast("int"), F.lit(0)) for k in GRID))
    good = m.where("quality = 1").groupBy("stratum", *(f"q_{k}" for k in GRID)).agg(F.count("*").alias("n"))
    t = good.join(steps, "stratum").groupBy("stratum", "step", *(f"c_{k}" for k in GRID)).agg(F.sum("n").alias("n"), F.sum(F.col("n") * rejected).alias("k"))
    tail = F.when(F.col("k") < F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk) <= F.log(F.lit(error / max(1, strata))))
    before = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # 80 rows at most
    t = t.withColumn("passed", F.min(F.coalesce(tail, F.lit(False))).over(before)).where("passed")
    last = t.groupBy("stratum").agg(F.max(F.struct("step", *(f"c_{k}" for k in GRID))).alias("s")).select("stratum", *(f"s.c_{k}" for k in GRID))
    return last.where(F.coalesce(*(f"c_{k}" for k in GRID)).isNotNull())


def judged(measures: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The measured documents with kept."""
    d = measures.withColumn("q_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    d = d.join(cutoffs.withColumnRenamed("stratum", "q_stratum"), "q_stratum", "left")
    rejected = F.lit(False)
    for k in GRID:
        rejected = rejected | F.coalesce(F.col(f"q_{k}") > F.col(f"c_{k}"), F.lit(False))
    return d.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("q_stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """columns of the documents, with counts, base_failed and kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [c for c in columns if c not in counts]
    m = checkpointed(measured(docs.select(*dict.fromkeys([*own, "doc_id", "lang", "text"]))).select(*dict.fromkeys([*own, "doc_id", "lang"]), *counts, *(f"q_{k}" for k in GRID)))
    return judged(m, written(certified_cutoffs(m, labels))).select(*own, *counts, "kept")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their columns as they were, whatever they are called. A verdict depends on
    language and text alone, so only ids and hashes of these are stored for rejected rows: texts in a checkpoint would
    lie on disk as long as the result is in use, beside all that the next stage writes. The hashed join moves each text
    once and sorts none."""
    key = lambda d: F.xxhash64(d["lang"], d["text"])
    rows = quality_rules(docs.select("doc_id", "lang", "text", key(docs).alias("key")), table(spark, sf_dir, "labels"), ["doc_id", "key"])
    gone = written(rows.where(~F.coalesce("kept", F.lit(False))).select("doc_id", "key").distinct()).hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (key(docs) == gone["key"]), "left_anti")
