"""From raw documents to packed training sequences: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucerna.llm.common import checkpointed, table
from lucerna.llm.decontaminate import decontaminate_stage
from lucerna.llm.jaccard_join import join_stage
from lucerna.llm.packing import packing_stage
from lucerna.llm.pii import pii_stage
from lucerna.llm.quality import quality_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go; nulls count as empty texts."""
    return quality_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; texts without words are linked with nothing and stay."""
    return join_stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each judged by its own text; null and empty texts stay."""
    return decontaminate_stage(spark, docs, sf_dir)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates and n_chars follows; rows, ids and other columns stay as they are."""
    return pii_stage(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents become pieces, each with its sequence and offset; a null text is an empty one."""
    return packing_stage(spark, docs, sf_dir)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]
#: The certified thresholds, the components of links and the packing plan are not expressed in SQL; tests/llm holds brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on a checkpoint of what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
