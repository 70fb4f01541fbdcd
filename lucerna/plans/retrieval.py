"""Document retrieval: chunks, lexical scores from term statistics, vector scores, their mixture, and a diverse choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Query vectors that are broadcast at a time.
BLOCK = 1024


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lexical_scores(docs: DataFrame, queries: DataFrame, doc: str, query: str) -> DataFrame:
    """BM25: (query, document, score). Only words that queries ask for are counted; document lengths come from all."""
    words = docs.select(doc, words_of("text").alias("__w")).withColumn("__length", F.size("__w"))
    asked = queries.select(query, F.explode(F.array_distinct(words_of("text"))).alias("term"))
    terms = asked.select("term").distinct()
    hit = words.select(doc, "__length", F.explode("__w").alias("term")).join(terms, "term").groupBy(doc, "__length", "term").agg(F.count("*").alias("tf"))
    whole = docs.select(F.size(words_of("text")).alias("n")).where("n > 0").agg(F.count("*").alias("__n"), F.avg("n").alias("__mean"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(df, "term").crossJoin(F.broadcast(whole)).join(asked, "term")  # one row
    idf = F.log1p((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__length") / F.col("__mean")))
    return scored.groupBy(query, doc).agg(F.round(F.sum(idf * tf), 6).alias("score"))


def best(scored: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The k documents of each query with the greatest score, with their place."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def lexical(docs: DataFrame, queries: DataFrame, doc: str, query: str, k: int) -> DataFrame:
    return best(lexical_scores(docs, queries, doc, query), query, doc, k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)))


def nearest(rows: DataFrame, queries: DataFrame, id_: str, vector: str, query: str, query_vector: str, k: int, where: Column | None = None) -> DataFrame:
    """(query, document, score, place): exact cosine neighbours of each query among all rows that pass the filter. Query
    vectors go out in blocks of bounded size; each batch of rows keeps its k best for each query. Null vectors and
    vectors of zeros have no neighbours."""
    rows = rows if where is None else rows.where(where)
    asked = queries.select(query, query_vector).where(F.col(query_vector).isNotNull()).orderBy(query).toLocalIterator()
    out, block = None, []

    def scored(block: list) -> DataFrame:
        ids, q = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        sent = rows.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))  # BLOCK vectors

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                t = pd.DataFrame({"id": b.column(0).to_pandas(), "v": b.column(1).to_pandas()}).dropna()
                if len(t):
                    x = np.stack(t["v"].to_numpy()).astype(np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    x, own = x[norm > 0] / norm[norm > 0, None], t["id"].to_numpy(np.int64)[norm > 0]
                    s = np.round(q @ x.T, 9)
                    few = min(k, len(own))
                    edge = np.partition(s, len(own) - few, axis=1)[:, len(own) - few, None] if few else s[:, :0]
                    i, j = np.nonzero(s >= edge) if few else (np.zeros(0, int), np.zeros(0, int))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(s[i, j])], [query, id_, "score"])

        return rows.select(F.col(id_).cast("long"), vector).mapInArrow(score, f"{query} long, {id_} long, score double")

    for r in asked:
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            out, block = scored(block) if out is None else out.union(scored(block)), []
    if block or out is None:
        block = block or [(0, [1.0])]
        last = scored(block) if len(block[0][1]) > 1 or out is not None else rows.sparkSession.createDataFrame([], f"{query} long, {id_} long, score double")
        out = last if out is None else out.union(last)
    return best(out, query, id_, k)


def hybrid(lexical_: DataFrame, vector: DataFrame, query: str, doc: str, k: int, weight: float = 0.6) -> DataFrame:
    """Weighted mixture of vector scores and of lexical scores over the greatest of their query; a document that one of
    the two lacks has 0 there."""
    top = lexical_.groupBy(query).agg(F.max("score").alias("__top"))
    lex = lexical_.join(top, query).select(query, doc, F.try_divide("score", F.nullif(F.col("__top"), F.lit(0.0))).alias("__lexical"))
    both = vector.select(query, doc, F.col("score").alias("__vector")).join(lex, [query, doc], "full")
    score = F.round(weight * F.coalesce("__vector", F.lit(0.0)) + (1 - weight) * F.coalesce("__lexical", F.lit(0.0)), 9)
    return best(both.select(query, doc, score.alias("score")), query, doc, k)


def diverse(found: DataFrame, query: str, text: str, key: str, k: int, penalty: float = 0.1, most: int = 4) -> DataFrame:
    """A greedy choice of k of each query's candidates (a bounded pool, as `best` makes it): each choice lowers what is
    left with its key by the penalty; equal texts are taken once, a key at most `most` times."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, chosen, seen, used = pdf.sort_values(["score", key], ascending=[False, True], kind="stable").to_dict("records"), [], set(), {}
        while left and len(chosen) < k:
            left = [r for r in left if r[text] not in seen and used.get(r[key], 0) < most]
            if not left:
                break
            r = max(left, key=lambda r: r["score"] - penalty * used.get(r[key], 0))
            left.remove(r)
            chosen.append({**r, "place": len(chosen) + 1})
            seen.add(r[text])
            used[r[key]] = used.get(r[key], 0) + 1
        return pd.DataFrame(chosen, columns=[*pdf.columns.drop("place", errors="ignore"), "place"])

    columns = [f for f in found.schema.fields if f.name != "place"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", place long"
    return found.groupBy(query).applyInPandas(choose, schema)


def packed(text: str, limit: int) -> list[str]:
    """Words, in chunks of at most limit characters with the blanks between."""
    out, now, size = [], [], -1
    for w in text.split():
        if now and size + 1 + len(w) > limit:
            out.append(" ".join(now))
            now, size = [], -1
        now.append(w)
        size += 1 + len(w)
    return [*out, " ".join(now)] if now else out


def chunks(docs: DataFrame, doc: str, text: str = "text", limit: int = 800) -> DataFrame:
    """(doc, chunk, text, chunk_id): words packed greedily up to a number of characters; a longer word is a chunk of its
    own. The id is a hash of document and place. Null and empty texts have no chunks."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(t or "", limit))

    out = docs.select(F.col(doc), F.posexplode(parts(text)).alias("chunk", "text"))
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("/", F.col(doc).cast("string"), F.col("chunk").cast("string")), 256))
