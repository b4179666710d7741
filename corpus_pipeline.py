"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before
the next stage, so a stage's scratch tables are deleted when the next one begins.

Cases: null and empty texts, null ids, ties, repeated rows and very long texts are those of the stages'
modules; a document with a null or empty text is near to none and stays; repeated rows of a document that
stays all stay; all stages but the last keep all columns, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from capture_analytics.llm import bpe, fmindex, jaccard, phrases, tables, toxic
from capture_analytics.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """Delete what the stage before left in the shared folder; its result has been written."""
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables.delete(spark, _left)
        with tables.scratch() as own:
            out = f(spark, docs, sf_dir)
        _left.extend(own)
        return out
    return run


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, learned from the labels of those at hand."""
    return toxic.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles, over any number of links, the smallest id."""
    return jaccard.one_of_each(docs)


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller id has."""
    return phrases.deduplicated(docs, length="n_chars")


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark."""
    return fmindex.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with digests of the ids and of their decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]

# SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows, read from where they were written."""
    docs = tables.documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, f) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
