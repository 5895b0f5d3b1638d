"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Each stage takes what its predecessor kept, as a table with the columns of
``documents``, and returns such a table; the last returns token ids. Empty
tables pass through. Nulls: a null text is scored as an empty one, has no lines,
no set and no words; rows without a doc_id are kept or dropped by their text
alone, except that line and near-duplicate stages keep them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import quality
from spanveil.llm.leaks import keep_clean
from spanveil.llm.lines import dedup_lines
from spanveil.llm.neardup import keep_one
from spanveil.llm.queries import WORD_BPE
from spanveil.llm.tables import benchmark, documents, labels, saved
from spanveil.llm.tokens import round_trip


# Words of a repeated passage that goes although it stands on one or two lines.
PASSAGE = 50


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines, or of fewer lines with PASSAGE words. Documents that lose all lines go."""
    columns = docs.columns
    cut = dedup_lines(docs, words=PASSAGE).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return keep_clean(docs, benchmark(spark, sf_dir))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text that they decode to."""
    return round_trip(docs, public_tokenizers.path(WORD_BPE))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("lines", lines),
    ("near_duplicates", near),
    ("decontamination", clean),
    ("encoding", encoded),
]

# SQL cannot express the classifier and the encoder; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
