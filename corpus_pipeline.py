"""Pipeline over ``documents``: quality, exact and near duplicates, decontamination, packing.

Each stage works on every row that its predecessor kept.  All but the last return
the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwood.llm.cotrain import keep_good
from graftwood.llm.decontaminate import contaminated
from graftwood.llm.exact_dedup import keep_first
from graftwood.llm.near_dedup import NearDedup, near_duplicates
from graftwood.llm.packing import pack
from graftwood.llm.scratch import materialize

#: Ids (8 bytes each) that are broadcast at most; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts; a row that repeats an id and its text goes too."""
    return keep_first(docs)


#: Ids of rows that have none, while a stage tells rows apart; they follow all others.
FIRST_MADE_ID = 1 << 62
_ID = "__pipeline_id"


def _identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with an id for every row in one more column: doc_id, or a made one where it is null, which is written out so that it stays."""
    own = F.col("doc_id").cast("long")
    if docs.filter("doc_id is null").isEmpty():
        return docs.withColumn(_ID, own)
    return materialize(docs.withColumn(_ID, F.coalesce(own, F.monotonically_increasing_id() + FIRST_MADE_ID)), f"pipeline-{name}-ids")


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone``: a list of up to BROADCAST_IDS ids is broadcast, a longer one shuffled."""
    gone = materialize(gone.select(F.col("doc_id").cast("long").alias("__gone_id")).distinct(), f"pipeline-{name}")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[_ID] == F.col("__gone_id"), "left_anti").drop(_ID)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.  Rows without an id are told apart like any others."""
    docs = _identified(docs, "near")
    return _without(docs, near_duplicates(docs, NearDedup(), _ID).filter("not kept"), "near-gone")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whether or not they have an id."""
    docs = _identified(docs, "leaks")
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=_ID), "leaks-gone")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of several permitted lengths."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: Fitting a classifier and packing can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
