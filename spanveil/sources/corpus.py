"""Labelled corpora: schema, splits and the redaction output layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.spans import SPANS_DDL
from spanveil.operators.limits import head_n

CORPUS_DDL = (
    "id STRING, language STRING, set STRING, source_text STRING, target_text STRING, "
    f"privacy_mask {SPANS_DDL}, span_labels STRING, "
    "mbert_text_tokens ARRAY<STRING>, mbert_bio_labels ARRAY<STRING>"
)

# The two splits that are kept.
SPLITS = ("train", "validation")
# Session setting: files that a task may have open at once.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A saved corpus; parquet brings its own schema, JSON gets the standard one."""
    reader = spark.read.format(fmt)
    if schema or fmt != "parquet":
        reader = reader.schema(schema or CORPUS_DDL)
    return reader.load(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save the train and validation rows, one directory per split.

    A task has a file of each split open at once. Otherwise Spark would sort
    whole rows by split before it writes them, and spill several times the input.
    """
    conf = df.sparkSession.conf
    before = conf.get(OPEN_FILES)
    # With as many files open as are allowed, Spark goes over to the sort.
    conf.set(OPEN_FILES, max(int(before), len(SPLITS) + 1))
    try:
        df.filter(F.col("set").isin(*SPLITS)).write.mode(mode).partitionBy("set").parquet(path)
    finally:
        conf.set(OPEN_FILES, before)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its directory is listed and read."""
    return spark.read.parquet(path).filter(F.col("set") == split)


def split_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("set").isin(*SPLITS)).groupBy("set").agg(F.count("*").alias("rows"))


def split_sample(df: DataFrame) -> DataFrame:
    """The first train row: id, language, set, source and target text."""
    train = df.filter(F.col("set") == "train")
    return head_n(train, "id", 1).select("id", "language", "set", "source_text", "target_text")


def head_per_split(df: DataFrame, train_rows: int = 1000, validation_rows: int = 100) -> DataFrame:
    """The first rows of both splits; a smaller split gives all it has."""
    train = head_n(df.filter(F.col("set") == "train"), "id", train_rows)
    return train.unionByName(head_n(df.filter(F.col("set") == "validation"), "id", validation_rows))


def corpus_output(redacted: DataFrame) -> DataFrame:
    """The eleven result columns of a redacted corpus."""
    return redacted.select(
        "id",
        "language",
        "set",
        F.col("source_text").alias("original_source_text"),
        F.col("target_text").alias("original_target_text"),
        F.col("privacy_mask").alias("original_privacy_mask"),
        F.col("span_labels").alias("original_span_labels"),
        "redacted_text",
        "pii_entities",
        "mbert_text_tokens",
        "mbert_bio_labels",
    )
