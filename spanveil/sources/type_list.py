"""The list of entity types to look for."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.functions.text import strip
from spanveil.operators.rules import DEFAULT_TYPES

_log = logging.getLogger(__name__)


def read_types(spark: SparkSession, path: str) -> list[str]:
    """Types from a file, one per line: stripped, blanks dropped, order and repeats kept.

    A file that cannot be read gives the default list. The list is part of every
    prompt and plan, so the driver holds all of it.
    """
    try:
        whole = spark.read.text(path, wholetext=True).select(
            F.explode(F.split("value", "\r\n|\r|\n")).alias("line")
        )
        lines = [r[0] for r in whole.select(strip(F.col("line")).alias("t")).filter("t != ''").collect()]
    except Exception as problem:
        _log.warning("cannot read types from %s, using the default list: %s", path, problem)
        return list(DEFAULT_TYPES)
    return lines


def choose_types(
    spark: SparkSession, types: Sequence[str] | None = None, types_file: str | None = None
) -> list[str]:
    """The given list, even an empty one, else the file's, else the default."""
    if types is not None:
        return list(types)
    if types_file is not None:
        return read_types(spark, types_file)
    return list(DEFAULT_TYPES)
