"""Queries of retrieval: the lexical index, mixtures, indexes of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ACCENTS
from ..plans import lexical_index as LX
from ..plans import retrieval as R
from ..plans import vector_index as VX
from ..sources.files import parquet


def lexical_retrieval(spark, d):
    """The three best documents of each benchmark item, from the index: covered terms by rarity, phrases, variants."""
    index = LX.build(parquet(spark, d, "documents"), "doc_id")
    return LX.best(index, parquet(spark, d, "benchmark"), "item_id", 3).select("item_id", "doc_id", "place", "score")


def variant_retrieval(spark, d):
    """Questions made of the first words of every hundredth document; "the", "der" and "of", "und" stand for each other."""
    docs = parquet(spark, d, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"))
    index = LX.build(docs, "doc_id")
    return LX.best(index, asked, "query", 4, {"the": ("the", "der"), "of": ("of", "und")}).select("query", "doc_id", "place", "score")


def phrase_search(spark, d):
    """Documents with the three words in a row, from positions alone, and how often."""
    index = LX.build(parquet(spark, d, "documents"), "doc_id")
    return LX.phrase(index, ["and", "the", "of"]).select("doc_id", F.size("starts").alias("n"))


def hybrid_retrieval(spark, d):
    """Lexical scores from the index and exact vector scores, mixed."""
    docs = parquet(spark, d, "documents").select("doc_id", "text")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text")
    lex = LX.best(LX.build(docs, "doc_id"), q, "query", 20)
    e = parquet(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    vec = R.nearest(e, asked, "vec_id", "embedding", "query", "asked", 20).withColumnRenamed("vec_id", "doc_id")
    return R.hybrid(lex, vec, "query", "doc_id", 5).select("query", "doc_id", F.round("score", 5).alias("score"), "place")


def _vectors(spark, d):
    e = parquet(spark, d, "embeddings")
    return e.select("vec_id", "embedding", F.col("label").alias("label"), F.sha2(F.col("embedding").cast("string"), 256).alias("content"))


def _asked(spark, d):
    e = parquet(spark, d, "embeddings").where("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))


def filtered_neighbours(spark, d):
    """The four nearest vectors of each query among those with label 3, exactly, from the index: cells that can't hold one
    of them are not read. Label 99 has none: there the search is done again without the filter."""
    index = VX.build(_vectors(spark, d), "vec_id", "embedding", "content")
    asked = _asked(spark, d)
    some = VX.search(index, asked, "query", "asked", 4, where=F.col("label") == 3, exact=True).withColumn("label", F.lit(3))
    none = VX.search(index, asked, "query", "asked", 4, where=F.col("label") == 99, exact=True).withColumn("label", F.lit(99))
    return some.union(none).select("label", "query", "vec_id", "place", "filtered")


def probed_neighbours(spark, d):
    """The five nearest vectors of each query in the cells nearest to it; tests measure the recall."""
    index = VX.build(_vectors(spark, d), "vec_id", "embedding", "content")
    return VX.search(index, _asked(spark, d), "query", "asked", 5).select("query", "vec_id", "place")


QUERY_LIST = (lexical_retrieval, variant_retrieval, phrase_search, hybrid_retrieval, filtered_neighbours, probed_neighbours)

_STOP = ", ".join(f"'{w}'" for w in LX.STOP_WORDS)
_GENERIC = ", ".join(f"'{w}'" for w in sorted({LX.stemmed(g) for g in LX.GENERIC}))


def _words(table: str, key: str, text: str = "text") -> str:
    cut = f"regexp_split_to_array(translate(lower(coalesce({text}, '')), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[^\\p{{L}}\\p{{N}}]+')"
    return f"SELECT {key}, list_transform(list_filter({cut}, lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: regexp_replace(w, '^(.{{3,}}[rlndzj])es$|^(.{{3,}})s$', '\\1\\2')) AS w FROM {table}"


_INDEX = f"""t AS ({_words("documents", "doc_id")}), n AS (SELECT count(*) AS size, sum(len(w)) / count(*) AS mean FROM t),
    o AS (SELECT doc_id, len(w) AS length, w[i] AS term, w[i + 1] AS nxt, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM t)),
    c AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length, list(DISTINCT nxt) AS nexts FROM o GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY ALL)"""


def _asked_sql(table: str, key: str, text: str = "text", choice: str = "[word]") -> str:
    return f"""qw AS (SELECT {key}, list_filter(w, lambda x: x NOT IN ({_GENERIC})) AS w FROM ({_words(table, key, text)})),
    qe AS (SELECT {key}, w[i] AS word, w[i + 1] AS nxt FROM (SELECT {key}, w, unnest(generate_series(1, len(w))) AS i FROM qw)),
    qs AS (SELECT {key}, word, {choice} AS choice FROM qe GROUP BY {key}, word),
    qd AS (SELECT DISTINCT {key}, choice FROM qs), qv AS (SELECT {key}, choice, unnest(choice) AS term FROM qd),
    qi AS (SELECT {key}, choice, ln(1 + (size - max(coalesce(df, 0)) + 0.5::DOUBLE) / (max(coalesce(df, 0)) + 0.5::DOUBLE)) AS idf FROM qv LEFT JOIN f USING (term), n GROUP BY {key}, choice, size),
    qn AS (SELECT {key}, sum(idf) AS whole FROM qi GROUP BY ALL),
    tfs AS (SELECT {key}, doc_id, choice, sum(tf) AS tf, max(length) AS length FROM qv JOIN c USING (term) GROUP BY ALL),
    base AS (SELECT {key}, doc_id, sum(idf * least(1, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * length / mean)))) / max(whole) AS s FROM tfs JOIN qi USING ({key}, choice) JOIN qn USING ({key}), n GROUP BY ALL),
    qp AS (SELECT e.{key}, a.choice[1] AS term, b.choice[1] AS nxt FROM qe e JOIN qs a ON a.{key} = e.{key} AND a.word = e.word JOIN qs b ON b.{key} = e.{key} AND b.word = e.nxt WHERE a.choice[1] <> b.choice[1]),
    bonus AS (SELECT {key}, doc_id, count(*) AS p FROM qp JOIN c USING (term) WHERE list_contains(nexts, qp.nxt) GROUP BY ALL),
    scored AS (SELECT {key}, doc_id, round(least(1, s + least(0.15::DOUBLE * coalesce(p, 0), 0.3::DOUBLE)), 6) AS score FROM base LEFT JOIN bonus USING ({key}, doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id)::INT AS place FROM scored)"""


_SIMILAR = "SELECT q.vec_id AS query, e.vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
_CHOICE = "CASE WHEN word = 'the' THEN ['the', 'der'] WHEN word = 'of' THEN ['of', 'und'] ELSE [word] END"

ORACLE_SQL = {
    "lexical_retrieval": f"WITH {_INDEX}, {_asked_sql('benchmark', 'item_id')} SELECT item_id, doc_id, place, score FROM placed WHERE place <= 3",
    "variant_retrieval": f"""WITH {_INDEX}, src AS (SELECT doc_id AS query, array_to_string(string_split(text, ' ')[1:12], ' ') AS text FROM documents WHERE doc_id % 100 = 0), {_asked_sql('src', 'query', choice=_CHOICE)}
        SELECT query, doc_id, place, score FROM placed WHERE place <= 4""",
    "phrase_search": f"WITH {_INDEX} SELECT a.doc_id, count(*)::INT AS n FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN o c2 ON c2.doc_id = a.doc_id AND c2.i = a.i + 2 WHERE a.term = 'and' AND b.term = 'the' AND c2.term = 'of' GROUP BY ALL",
    "hybrid_retrieval": f"""WITH {_INDEX}, src AS (SELECT doc_id AS query, text FROM documents WHERE doc_id % 100 = 0), {_asked_sql('src', 'query')},
        lex AS (SELECT query, doc_id, score / max(score) OVER (PARTITION BY query) AS l FROM placed WHERE place <= 20),
        vec AS (SELECT query, vec_id AS doc_id, score AS v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM ({_SIMILAR})) WHERE r <= 20),
        mix AS (SELECT query, doc_id, round(0.6::DOUBLE * coalesce(v, 0) + 0.4::DOUBLE * coalesce(l, 0), 9) AS score FROM vec FULL JOIN lex USING (query, doc_id))
        SELECT query, doc_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS place FROM mix) WHERE place <= 5""",
    "filtered_neighbours": f"""WITH s AS ({_SIMILAR}) SELECT 3 AS label, query, vec_id, place, true AS filtered FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM s WHERE label = 3) WHERE place <= 4
        UNION ALL SELECT 99, query, vec_id, place, false FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM s) WHERE place <= 4""",
}
