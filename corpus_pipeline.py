"""From raw documents to training windows: five stages, each written and read again.

The stages work one after another on ``documents`` (doc_id, text, lang, source,
n_chars); all but the last return its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import exact_mph, mixing, near_circulant, packing, quality
from lexmill.llm.common import Workspace

#: Nine tenths of the tokens, no document twice: the hot sources give up the tenth.
MIXING = mixing.Mixing(budget=0.9, max_repetition=1.0)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` rejects go."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each text stays."""
    return exact_mph.exact_dedup(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group of near duplicates stays."""
    return near_circulant.near_dedup(spark, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Sources are brought to their target weights; what is taken is stored in training order."""
    return mixing.mix_rows(spark, docs, MIXING)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents are packed into windows in the order in which the mixture stored them; one row a window."""
    return packing.pack_windows(spark, docs, place=packing.stored_place())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("packing", window_packing),
]

#: The classifier is trained, so SQL can't express the rows; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the windows are returned."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 0:
            ws.drop(f"stage-{k - 1}")
    return docs
