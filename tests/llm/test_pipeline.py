import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute

import corpus_pipeline as P
from lucerna.llm import common, decontaminate, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_job_a_step(spark):
    """Small tables: adaptive execution would run a job for each shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_stages(spark):
    """What each stage keeps, from its own input: the verdicts, the components of all pairs, the benchmark's hits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        before, had = docs, docs.select("doc_id", "text").collect()
        docs = stage(spark, docs, SF).cache()
        kept = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and kept <= ids and len(kept) == docs.count(), name
        if name == "quality rules":
            want = {r["doc_id"] for r in quality.op6(spark, SF).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            want = {d if c is None else c for d, _, c in brute([tuple(r) for r in had])[0]}
        elif name == "benchmark decontamination":
            want = ids - {r["doc_id"] for r in decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            want = ids
        assert kept == want, name
        ids = kept
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids


CLASHING = ["key", "rows", "kept", "n_words", "component_id", "seed", "words", "at", "sequence_id", "base_failed"]


def test_stages_on_hard_rows(spark):
    """Null in every column, empty, repeated and very long texts, repeated ids, columns named like the stages' own: no
    stage crashes or loses a clean document; on an empty table each gives none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    real = docs.where("text is not null").orderBy("doc_id").limit(30)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(3)
    clean = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (60, 80, 100, 120, 200_000)]
    texts = [(None, None), (None, ""), (None, clean[0]), (None, clean[1]), (900001, clean[2]), (900001, clean[3]), (900002, clean[2]), (900003, clean[4]), (None, f"{clean[0][::-1]} {item}"), (900004, "")]
    hard = spark.createDataFrame(texts, "doc_id long, text string").select(*(c if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    rows = real.unionByName(hard).unionByName(real.limit(3)).select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))).cache()
    for empty in (False, True):
        got = rows.limit(0) if empty else rows
        for name, stage in P.STAGES[:-1]:
            got = stage(spark, got, SF).cache()
            assert got.columns == rows.columns, name
            left = {r["text"] for r in got.collect()}
            assert not left if empty else set(clean) <= left, name
        packed = P.STAGES[-1][1](spark, got, SF).collect()
        assert bool(packed) != empty
        if not empty:
            assert got.where("text like '%w1%'").count() == len(clean) and not any(item in t for t in left)
            assert sum(r["length"] for r in packed) == packing.pieces_of(got).agg(F.sum("length")).first()[0]


def test_quality_leaves_no_texts_on_disk(spark):
    """The next stage works while the result is in use; what that keeps in the shared folder counts beside it. Rows of
    equal or null ids are told apart by language and text."""
    rng = random.Random(8)
    long_ = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(10_000)) for _ in range(40)]
    keep = [*((k, t, "en") for k, t in enumerate(long_)), (None, long_[0], None), (None, long_[0], None), (7, long_[1], "de"), (0, long_[2], "en")]
    drop = [(None, None, None), (7, None, None), (0, "", "en"), (None, "few words", "en"), (3, "a b c " * 50, None), (3, "a b c " * 50, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(keep + drop)], "doc_id long, text string, lang string, `key` int")
    folder = Path(urlparse(common.shared_folder(spark)).path)
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = quality.quality_stage(spark, docs, SF)
    assert size() - before < sum(map(len, long_)) / 20
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, keep))
