"""A corpus for training, from the table documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascope.llm import byte_bpe, line_dedup, mixing, near_dedup, queries, toxicity
from stratascope.llm.common import drop_written, keeps, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, docs, sf_dir), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document, but for two edits, go; n_chars follows the text."""
    kept = line_dedup.without_repeats(docs, edits=2, least_chars=20)
    return keeps(kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns), kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8 or more."""
    return near_dedup.near_unique(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs, cycle=(5, 2, 1), share=1.0, cap=3)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded_digests(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Edit joins, signatures and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before: DataFrame | None = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = written(made, f"stage-{name}")
        drop_written(made, before)
        before = docs
    return docs
