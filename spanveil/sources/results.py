"""Redaction results on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.functions.spans import SPANS_DDL

RESULTS_DDL = (
    "id STRING, language STRING, set STRING, original_source_text STRING, original_target_text STRING, "
    f"original_privacy_mask {SPANS_DDL}, original_span_labels STRING, redacted_text STRING, "
    f"pii_entities {SPANS_DDL}, mbert_text_tokens ARRAY<STRING>, mbert_bio_labels ARRAY<STRING>"
)


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Save results, one file per task: JSON lines in UTF-8, or parquet."""
    df.write.mode(mode).format(fmt).save(path)


def read_results(
    spark: SparkSession, path: str, fmt: str = "json", array_file: bool = False, schema: str = RESULTS_DDL
) -> DataFrame:
    """Results for scoring.

    ``array_file`` reads files that hold one indented JSON array. Such a file
    cannot be split, one task reads all of it; JSON lines have no such limit.
    """
    reader = spark.read.format(fmt).schema(schema)
    if array_file:
        reader = reader.option("multiLine", True)
    return reader.load(path)
