"""The entity span type and its array and row forms.

Offsets are 0-based code points and ``end`` is exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import name

SPAN_DDL = "STRUCT<label: STRING, value: STRING, start: INT, end: INT>"
SPANS_DDL = f"ARRAY<{SPAN_DDL}>"
NO_SPANS = f"CAST(array() AS {SPANS_DDL})"


def span(label: str, value: str, start: str, end: str) -> str:
    """SQL text of one span."""
    return (
        f"named_struct('label', {label}, 'value', {value}, "
        f"'start', CAST({start} AS INT), 'end', CAST({end} AS INT))"
    )


def span_rows(df: DataFrame, spans_col: str, *keep: str) -> DataFrame:
    """One row per span: the ``keep`` columns, ``pos``, then the span's fields."""
    # filter() keeps the generator input from being a bare column. For a bare
    # column Spark infers a size > 0 filter and pushes it below the projection
    # that computes the spans, which would run the whole detection twice.
    spans = F.expr(f"posexplode(filter({name(spans_col)}, s -> s IS NOT NULL))").alias("pos", "_span")
    return df.select(*keep, spans).select(*keep, "pos", "_span.label", "_span.value", "_span.start", "_span.end")
