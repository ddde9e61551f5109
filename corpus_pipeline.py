"""From raw documents to packed training sequences: five stages, each of which calls one operator of ``siftgate.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; its rows are written as Parquet
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftgate.llm import bestfit_packing, line_dedup, minhash_dedup, mixing, quality_classifier
from siftgate.llm.common import table

#: Similarity in percent from which two documents count as near copies.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut out; a document of which no word is left goes."""
    return line_dedup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return minhash_dedup.one_of_each(docs, percent=NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    return bestfit_packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_copies), ("mixing sources", mixture), ("best-fit packing", packing)]
#: Tokenizing and near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
