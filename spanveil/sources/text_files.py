"""Whole text files as one-row documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.text import normalise_newlines


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, original_text), one row per UTF-8 file; line ends become LF."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), normalise_newlines(F.col("value")).alias("original_text")
    )
