"""Places of given values in a text.

Values are looked up one by one in the row they came with: exact first
occurrence, else the first occurrence of the value without its spaces. A value
that is in neither form is dropped. Of several entities at the same place the
first in list order stays, whatever its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind
from spanveil.functions.spans import span
from spanveil.functions.text import find, name


def approximate_start(text: str, value: str) -> str:
    """SQL text: start of the value with its spaces removed, null when absent.

    A value of spaces only is found at 0 in any text that is not empty.
    """
    start = f"CASE WHEN packed <> '' THEN {find(text, 'packed')} WHEN length({text}) > 0 THEN 0 END"
    return bind(f"replace({value}, ' ', '')", "packed", start)


def value_start(text: str, value: str) -> str:
    return f"coalesce({find(text, value)}, {approximate_start(text, value)})"


def _located(text: str, entities: str) -> str:
    return (
        f"transform({entities}, (e, pos) -> named_struct('start', {value_start(text, 'e.value')}, "
        "'pos', pos, 'label', e.label, 'value', e.value))"
    )


def recovered_spans(text: str, entities: str) -> str:
    """SQL text of the spans of an entity array, deduplicated by place, in list order.

    ``end`` is the start plus the length of the value as given, so after an
    approximate match it runs past the text found by the number of spaces.
    """
    placed = (
        f"array_sort(transform(filter({_located(text, entities)}, e -> e.start IS NOT NULL), "
        "e -> named_struct('start', e.start, 'end', e.start + length(e.value), "
        "'pos', e.pos, 'label', e.label, 'value', e.value)))"
    )
    # Sorted by place and position: the first of each run of equal places is
    # the one to keep, found by looking at the left neighbour only.
    first_at_place = bind(
        placed,
        "sorted",
        "filter(sorted, (e, i) -> i = 0 OR e.start <> get(sorted, i - 1).start OR e.end <> get(sorted, i - 1).end)",
    )
    kept = span("e.label", "e.value", "e.start", "e.end")
    in_list_order = f"array_sort(transform({first_at_place}, e -> named_struct('pos', e.pos, 'span', {kept})))"
    return f"transform({in_list_order}, e -> e.span)"


def recover_spans(
    df: DataFrame, text_col: str, entities_col: str, output_col: str = "pii_entities"
) -> DataFrame:
    """Append the spans of an array of ``(label, value)`` structs."""
    return df.withColumn(output_col, F.expr(recovered_spans(name(text_col), name(entities_col))))


def unlocated_values(df: DataFrame, text_col: str, entities_col: str, *keep: str) -> DataFrame:
    """One row per entity that is not in its text: the kept columns, pos, label, value."""
    lost = f"filter({_located(name(text_col), name(entities_col))}, e -> e.start IS NULL)"
    rows = df.select(*keep, F.expr(f"explode({lost})").alias("_lost"))
    return rows.select(*keep, "_lost.pos", "_lost.label", "_lost.value")
