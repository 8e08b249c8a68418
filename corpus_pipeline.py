"""From raw documents to token ids: quality rules, exact and near duplicates, source mixing, piece encoding.

Each stage reads what the stage before it wrote, works on all of it, and its
decisions take effect in the rows it returns. What a stage staged for itself is
deleted when the next one begins, since its result has been written by then.
What a stage computes reaches Python in batches bounded in rows and bytes, and is written in
bounded pages and row groups. The rows that a stage returns are computed after it has returned,
so it leaves the options for that set on the session; ``run`` restores them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.llm import exact_dedup, mixing, near_dedup, pieces, quality
from sitesignal.llm.queries import tokenizer_file
from sitesignal.session import keep_long_rows_bounded, long_rows, page_batches, release, stage, staging_group

GROUP = "corpus-pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, score, ids, scores, segmentations)``: the N best piece segmentations of every document of the mix, and the best one by itself."""
    rows = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer_file("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", F.element_at("scores", 1).alias("score"), F.element_at("segmentations", 1).alias("ids"), "scores", "segmentations")


def _tidy(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, GROUP)
        keep_long_rows_bounded(spark)
        with staging_group(GROUP), page_batches(spark):
            return step(spark, docs, sf_dir)

    return run_step


STAGES = [
    ("quality_rules", _tidy(quality_rules)),
    ("exact_dedup", _tidy(exact_copies)),
    ("near_dedup", _tidy(near_copies)),
    ("source_mixing", _tidy(source_mix)),
    ("piece_encoding", _tidy(piece_encoding)),
]

#: the quality model, the signatures and the pieces are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with long_rows(spark):
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), name)
    release(spark, GROUP)
    return docs
