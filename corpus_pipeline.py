"""Documents to packed sequences: five stages, each written as Parquet and read by the next.

Language identification, exact duplicates, near-duplicates (five words, similarity 0.8 or more),
mixing of sources, packing.  Every stage but the last returns rows of its input with the columns
they came with.  SQL cannot express the first and the last stage, so there is no SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.llm import exact, language, minhash, mixing, packing
from leakframe.llm.storage import stored, unused
from leakframe.session import configure, small_side

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def configured(stage: Stage) -> Stage:
    """A stage may be called by itself, and needs the session's settings then too: without them ten
    thousand texts of any length go to Python in one batch."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return call


@configured
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a learned language.  Without any labelled document nothing is known
    and all go."""
    return language.identified(docs, language.train(docs))


@configured
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs)


@configured
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.  Rows without an id stay.  A row goes by
    its id and the hash of its text, so another text with the id of a dropped one stays."""
    gone, text_hash = unused(docs, "_gone", "_hash")
    lost = minhash.near_groups(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias(gone), F.col("text_hash").alias(text_hash)
    ).distinct()
    same = (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(text_hash))
    return docs.join(small_side(lost), same, "left_anti")


@configured
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as came in, shared among the sources by weight, at most twice each source's."""
    return mixing.mixed(docs, share=1.0)


@configured
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
