"""Answers against their sources: sentences with figures, trends or list items that no source supports go.

A figure has several readings, as points and commas part thousands or decimals. Claims are exploded from an answer's pieces
and joined to the readings of its sources by answer and reading, so that many sources may stand behind one answer; a piece
stays if each of its figures has a reading that a source or the question has. An answer whose pieces are all supported comes
back as it was. Null answers are empty; sources that are missing support nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plain

NUMBER = r"(?<!\w)(\d+(?:[.,]\d+)*)(?!\w)"
#: What opens a list item, and where a sentence ends.
MARKER = r"^\s*(?:\d{1,2}[.)]|[*\-•])\s+"
SENTENCE = r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])"
# Stems of Spanish verbs of rise and fall, with their endings.
TREND = (
    r"(?<![a-z])(?:sub(?:io|ieron|e|en)|baj(?:o|aron|a|an)|aument(?:o|aron|a|an)|disminu(?:yo|yeron|ye|yen)|crec(?:io|ieron|e|en)|cay(?:o|eron)|descend(?:io|ieron)|empeor(?:o|aron)|mejor(?:o|aron))(?![a-z])"
)
# Words that no list item is about.
COMMON = """para como esta este estos estas entre sobre segun tiene tienen donde cuando tambien solo cada otro otra otros otras desde hasta datos dato total valor valores tablero tableros indicador indicadores""".split()
#: List items of at most so many words are checked.
ITEM_WORDS = 6


def bare(digits: Column) -> Column:
    """Without separators and leading zeros."""
    out = F.regexp_replace(F.regexp_replace(digits, "[.,]", ""), "^0+", "")
    return F.when(out == "", "0").otherwise(out)


def readings(token: Column) -> Column:
    """The values that a written number can have, as texts."""
    out = [token, bare(token)]
    for mark in (r"\.", ","):
        head, tail = F.regexp_extract(token, rf"^(.*){mark}([^.,]*)$", 1), F.regexp_replace(F.regexp_extract(token, rf"^(.*){mark}([^.,]*)$", 2), "0+$", "")
        out.append(F.when(token.rlike(rf"{mark}[^.,]*$"), F.concat(bare(head), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def figures(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def content(text: Column | str) -> Column:
    """Words from four letters on that say something, as stems of five letters."""
    words = F.regexp_extract_all(plain(text), F.lit("[a-z0-9ñ]{4,}"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*COMMON)), lambda w: F.left(w, F.lit(5)))


def pieces(answers: DataFrame, id_: str, answer: str) -> DataFrame:
    """(id, line, piece, text): list items and empty lines whole, other lines by sentence."""
    lines = answers.select(id_, F.posexplode(F.split(F.coalesce(answer, F.lit("")), "\n")).alias("line", "__l"))
    parts = F.when((F.trim("__l") == "") | F.col("__l").rlike(MARKER), F.array("__l")).otherwise(F.split("__l", SENTENCE))
    return lines.select(id_, "line", F.posexplode(parts).alias("piece", "text"))


def unsupported(answers: DataFrame, sources: DataFrame, id_: str, answer: str, source: str, question: str | None = None) -> DataFrame:
    """(id, line, piece, text, why): the pieces that no source of the answer supports."""
    cut = pieces(answers, id_, answer).withColumn("__claim", F.regexp_replace("text", MARKER, ""))
    told = sources.select(id_, F.col(source).alias("__s"))
    asked = told if question is None else told.union(answers.select(id_, F.col(question)))
    known = asked.select(id_, F.explode(F.flatten(F.transform(figures("__s"), readings))).alias("__reading")).distinct()
    claims = cut.select(id_, "line", "piece", F.posexplode(figures("__claim")).alias("__n", "__token"))
    read = claims.select(id_, "line", "piece", "__n", F.explode(readings(F.col("__token"))).alias("__reading"))
    backed = read.join(known, [id_, "__reading"], "left_semi").select(id_, "line", "piece", "__n").distinct()
    figure = claims.join(backed, [id_, "line", "piece", "__n"], "left_anti").select(id_, "line", "piece").distinct().withColumn("why", F.lit("figure"))
    trends = cut.select(id_, "line", "piece", F.left(F.regexp_extract(plain(F.col("__claim")), TREND, 0), F.lit(5)).alias("__stem")).where("__stem <> ''")
    held = told.select(id_, plain(F.col("__s")).alias("__folded")).join(trends, id_).where(F.contains("__folded", "__stem")).select(id_, "line", "piece").distinct()
    trend = trends.join(held, [id_, "line", "piece"], "left_anti").select(id_, "line", "piece").withColumn("why", F.lit("trend"))
    items = cut.where(F.col("text").rlike(MARKER)).select(id_, "line", "piece", F.array_distinct(content(F.col("__claim"))).alias("__w")).where(F.size("__w").between(1, ITEM_WORDS))
    stems = told.select(id_, F.explode(content(F.col("__s"))).alias("__stem")).distinct()
    said = items.select(id_, "line", "piece", F.explode("__w").alias("__stem")).join(stems, [id_, "__stem"], "left_semi").select(id_, "line", "piece").distinct()
    item = items.join(said, [id_, "line", "piece"], "left_anti").select(id_, "line", "piece").withColumn("why", F.lit("item"))
    why = figure.union(trend).union(item).groupBy(id_, "line", "piece").agg(F.min_by("why", F.when(F.col("why") == "figure", 0).when(F.col("why") == "trend", 1).otherwise(2)).alias("why"))
    return cut.drop("__claim").join(why, [id_, "line", "piece"])


def grounded(answers: DataFrame, sources: DataFrame, id_: str, answer: str, source: str, question: str | None = None) -> DataFrame:
    """(id, grounded, removed): the answer without unsupported pieces, and how many went. Of an answer that
    loses pieces, lines without any left and headings (lines that end with a colon) go too."""
    bad = unsupported(answers, sources, id_, answer, source, question).select(id_, "line", "piece")
    counts = bad.groupBy(id_).agg(F.count("*").alias("removed"))
    kept = pieces(answers, id_, answer).join(bad, [id_, "line", "piece"], "left_anti")
    whole = kept.groupBy(id_, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), " ").alias("__t"))
    text = whole.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "__t"))), lambda p: p["__t"]), "\n").alias("__text"))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace("__text", r"\n{3,}", "\n\n"), r"(?m)^[^\n]*:[ \t]*$", ""), r"^\s+|\s+$", "")
    out = answers.select(id_, F.col(answer).alias("__a")).join(text, id_, "left").join(counts, id_, "left")
    return out.select(id_, F.when(F.col("removed").isNull(), F.coalesce("__a", F.lit(""))).otherwise(F.coalesce(tidy, F.lit(""))).alias("grounded"), F.coalesce("removed", F.lit(0)).alias("removed"))


def extract(sources: DataFrame, id_: str, source: str, asked: DataFrame, question: str, k: int = 2) -> DataFrame:
    """The extractive answer where none is left: the k sentences of the sources with most of the question's stems, in the
    order of the text; sentences without any do not count."""
    from pyspark.sql import Window

    cut = sources.select(id_, F.posexplode(F.split(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " "), SENTENCE)).alias("place", "text"))
    want = asked.select(id_, F.array_distinct(content(F.col(question))).alias("__q"))
    hits = cut.join(want, id_).withColumn("hits", F.size(F.array_intersect(content(F.col("text")), "__q"))).where("hits > 0")
    w = Window.partitionBy(id_).orderBy(F.desc("hits"), "place")
    best = hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return best.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), " ").alias("answer"))
