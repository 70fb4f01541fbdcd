"""What SQL does not express, against plain loops: chunks, hybrid scores, a diverse choice, matching, sources."""

from pyspark.sql import functions as F

from lucerna import queries as Q
from lucerna.functions import matching as MT
from lucerna.functions import scalars as S
from lucerna.operators import tables as T
from lucerna.plans import retrieval as R
from lucerna.sources import files

SF = "/root/testdata/sf0.001"


def packed(text, limit):
    out, now = [], ""
    for w in (text or "").split():
        if now and len(now) + 1 + len(w) > limit:
            out.append(now)
            now = ""
        now = f"{now} {w}" if now else w
    return out + [now] if now else out


def test_chunks(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(9000, None), (9001, ""), (9002, "x" * 900 + " y")]
    got = R.chunks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").orderBy("doc_id", "chunk").collect()
    want = [(d, k, c) for d, t in sorted(rows) for k, c in enumerate(packed(t, 800))]
    assert [(r["doc_id"], r["chunk"], r["text"]) for r in got] == want
    assert len({r["chunk_id"] for r in got}) == len(got)


def test_hybrid_scores_of_the_whole_table(spark):
    for r in Q.QUERIES["hybrid_retrieval"](spark, SF).collect():
        assert 0 <= r["score"] <= 1.000001 and 1 <= r["place"] <= 5
    lex = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0)], "q long, d long, score double")
    vec = spark.createDataFrame([(1, 11, 0.5), (1, 12, 0.9)], "q long, d long, score double")
    got = [(r["d"], r["score"]) for r in R.hybrid(lex, vec, "q", "d", 3).orderBy("place").collect()]
    assert got == [(12, 0.54), (11, 0.5), (10, 0.4)]


def test_diverse_choice(spark):
    rows = [(1, "a", "k", 0.9), (1, "a", "k", 0.89), (1, "b", "k", 0.85), (1, "c", "m", 0.8), (1, "d", "k", 0.5)]
    got = R.diverse(spark.createDataFrame(rows, "q long, text string, key string, score double"), "q", "text", "key", 3).orderBy("place").collect()
    assert [r["text"] for r in got] == ["a", "c", "b"]


def test_nearest_without_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "q long, a array<double>")
    assert [r["id"] for r in R.nearest(e, q, "id", "v", "q", "a", 5).orderBy("place").collect()] == [1, 4]
    assert R.nearest(e.limit(0), q, "id", "v", "q", "a", 5).count() == 0 and R.nearest(e, q.limit(0), "id", "v", "q", "a", 5).count() == 0


def test_matching(spark):
    df = spark.createDataFrame([("baca", "vaca"), ("peces", "pez"), ("ventas", "venta"), ("casa", "perro"), (None, "x")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(MT.edit_distance(a, b).alias("d"), MT.token_similarity(a, b).alias("s")).collect()
    assert got[0]["d"] == 0.5 and got[3]["d"] == -1.0
    assert got[1]["s"] == got[2]["s"] == 1.0 and got[3]["s"] < 0.5 and got[4]["s"] is None


def test_formats_and_series(spark):
    df = spark.createDataFrame([(1234.565,), (None,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(S.formatted(F.col("x"), "Standard")).collect()] == ["1.234,57", None, "-0,50"]
    assert [r[0] for r in T.series(spark, 3, 0, -1.5).collect()] == [3.0, 1.5, 0.0]
    assert T.dates(spark, "2024-02-27", "2024-03-01").count() == 4


def test_sources(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "g int, t string")
    old.write.parquet(f"{tmp_path}/old")
    new = spark.createDataFrame([(2, "x"), (2, "y")], "g int, t string")
    got = files.replace_groups(spark, new, f"{tmp_path}/old", "g", f"{tmp_path}/new")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'a')", "(2, 'x')", "(2, 'y')", "(None, 'n')"]
    for _ in range(2):
        files.append(new, f"{tmp_path}/log")
    assert files.json_lines(spark, f"{tmp_path}/log", "g int, t string").count() == 4
    (tmp_path / "doc.md").write_text("before\n# One\ntext\n## Two\nmore\n")
    got = files.markdown(spark, f"{tmp_path}/doc.md").orderBy("section").collect()
    assert [(r["heading"], r["text"]) for r in got] == [("", "before"), ("One", "text"), ("Two", "more")]
