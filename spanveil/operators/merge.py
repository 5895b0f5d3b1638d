"""Several detectors at once: their spans become one set without overlaps.

Rules, word lists and a model each look at the whole text. A sweep over the
spans of a row gives each character to the best span that covers it: that of the
first detector in order, of these the longest, then the one that begins first,
then the first label. Each stretch of one span is an entity. So whatever any
detector found is masked, and a span that better ones cut leaves its pieces, but
for pieces without a letter or digit.

The sweep is n log n in the spans of a row and stays inside the row. Rows whose spans
cross few others are swept together, as arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.batches import list_starts, slices
from spanveil.functions.spans import SPANS_DDL
from spanveil.operators.answer_table import redact_with_table
from spanveil.operators.answers import Predict, redact_with
from spanveil.operators.detect import with_segments
from spanveil.operators.lookup import PART_BYTES, with_list_segments
from spanveil.operators.rules import DEFAULT_RULES, DEFAULT_TYPES, Rule, select_rules

DETECTORS = ("rules", "lists", "model")
Span = tuple[int, int, int, str]
# Spans of a row are laid on the text one by one where each covers at most so many stretches on average.
FEW = 32


def swept(spans: Sequence[Span]) -> Iterator[tuple[int, int, int]]:
    """Stretches (start, end, number of the span) of the best span at each place; spans are (start, end, detector, label)."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][2], spans[i][0] - spans[i][1], spans[i][0], spans[i][3]))
    rank = {i: r for r, i in enumerate(order)}
    starts = sorted(range(len(spans)), key=lambda i: spans[i][0])
    edges = sorted({e for s in spans for e in s[:2]})
    active: list[tuple[int, int]] = []
    began, holder, k = 0, -1, 0
    for edge in edges:
        while k < len(starts) and spans[starts[k]][0] == edge:
            heapq.heappush(active, (rank[starts[k]], starts[k]))
            k += 1
        while active and spans[active[0][1]][1] <= edge:
            heapq.heappop(active)
        best = active[0][1] if active else -1
        if best != holder:
            if holder >= 0:
                yield began, edge, holder
            began, holder = edge, best


def merge_spans(df: DataFrame, text_col: str, spans_cols: Sequence[str]) -> DataFrame:
    """Replace the span columns, the best first, by ``redacted_text`` and ``pii_entities``.

    A column holds spans, or the segments of the whole text whose labelled ones
    are the spans. Null spans and spans that are empty or reach outside of the
    text are cut to what lies inside, or left out; values are read from the text.
    """

    columns = [c for c in df.columns if c not in (*spans_cols, "redacted_text", "pii_entities")]
    rows = df.select(*columns, F.struct(*(F.col(c).alias(f"d{i}") for i, c in enumerate(spans_cols))).alias("_found"))
    place = columns.index(text_col)
    added = T.StructType.fromDDL(f"redacted_text STRING, pii_entities {SPANS_DDL}")

    # A step of the plan and not a function in an expression: Spark would put the
    # expressions of the spans into its call, and fails to evaluate nested lambdas there.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = regex.compile(r"[\p{L}\p{N}]")
        for batch in slices(batches):
            merged = _merged(batch.column(place), batch.column(len(columns)), some)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *merged], names=[*columns, *added.names])

    return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in columns), *added]))


def _flat_spans(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, start, end and label of the spans of a column; those with a null among them are left out."""
    bounds = list_starts(found)
    row = np.repeat(np.arange(len(found)), np.diff(bounds))
    # The fields with the nulls of the structs.
    fields = dict(zip((f.name for f in found.type.value_type), found.flatten().flatten()))
    label = fields["label"]
    if "piece" in fields:
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(fields["piece"]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        first = ends[bounds[row]]
        start, end, good = ends[:-1] - first, ends[1:] - first, label.is_valid()
    else:
        good = pc.and_(pc.and_(fields["start"].is_valid(), fields["end"].is_valid()), label.is_valid())
        start, end = (fields[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    kept = np.asarray(good)
    return row[kept], start[kept], end[kept], label.filter(good)


def _held(spans: list[tuple], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, end and label number of the best span of each stretch, whether it is the whole span, and the labels."""
    row, start, end = (np.concatenate([s[i] for s in spans]) for i in range(3))
    detector = np.repeat(np.arange(len(spans)), [len(s[0]) for s in spans])
    coded = pa.concat_arrays([s[3].cast(pa.string()) for s in spans]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    number = np.argsort(np.argsort(np.array(names, dtype=object), kind="stable"))[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    start, end = np.maximum(start, 0), np.minimum(end, lengths[row])
    order = np.lexsort((number, start, start - end, detector, row))
    order = order[(start < end)[order]]
    row, start, end, number, detector = row[order], start[order], end[order], number[order], detector[order]
    # Places in all texts, one behind the other; stretches between the edges of spans go to the first span in order.
    base = np.cumsum(lengths + 1) - lengths - 1
    edges = np.unique(np.concatenate([base[row] + start, base[row] + end]))
    low, high = np.searchsorted(edges, base[row] + start), np.searchsorted(edges, base[row] + end)
    holder = np.full(len(edges), len(row))
    size = high - low
    many = np.bincount(row, size, len(lengths)) > FEW * np.bincount(row, minlength=len(lengths))
    direct = np.flatnonzero(~many[row])[::-1]
    size = size[direct]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    # Of several that are put to a place the last one stays.
    holder[np.repeat(low[direct], size) + inside] = np.repeat(direct, size)
    for r in np.flatnonzero(many):
        first, last = np.searchsorted(row, [r, r + 1])
        here = [(int(start[i]), int(end[i]), int(detector[i]), int(number[i])) for i in range(first, last)]
        for begin, stop, i in swept(here):
            holder[np.searchsorted(edges, base[r] + begin) : np.searchsorted(edges, base[r] + stop)] = first + i
    changes = np.flatnonzero(np.concatenate([[True], holder[1:] != holder[:-1]])) if len(holder) else np.zeros(0, np.int64)
    stops = np.append(changes[1:], len(holder))
    held = holder[changes] < len(row)
    begin, by = edges[changes[held]], holder[changes[held]]
    stop = edges[stops[held]]
    whole = stop - begin == end[by] - start[by]
    return row[by], begin - base[row[by]], stop - base[row[by]], number[by], whole, sorted(names)


def _merged(texts: pa.Array, found: pa.StructArray, some: regex.Pattern) -> tuple[pa.Array, pa.Array]:
    """The masked form and the entities of each text, by the columns in the fields of ``found``."""
    lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    spans = [_flat_spans(found.field(i)) for i in range(found.type.num_fields)]
    row, start, end, number, whole, names = _held(spans, lengths)
    strings = texts.to_pylist()
    kept = whole.copy()
    for k in np.flatnonzero(~whole).tolist():
        kept[k] = some.search(strings[row[k]], start[k], end[k]) is not None
    row, start, end, number = row[kept], start[kept], end[kept], number[kept]
    bounds = np.searchsorted(row, np.arange(len(strings) + 1))
    masks = [f"[{name}]" for name in names]
    starts, ends, numbers = start.tolist(), end.tolist(), number.tolist()
    masked, values = list(strings), []
    rows = np.flatnonzero(np.diff(bounds))
    for r, low, high in zip(rows.tolist(), bounds[rows].tolist(), bounds[rows + 1].tolist()):
        text, at, parts = strings[r], 0, []
        for k in range(low, high):
            parts += [text[at : starts[k]], masks[numbers[k]]]
            at = ends[k]
            values.append(text[starts[k] : at])
        masked[r] = "".join([*parts, text[at:]])
    labels = pa.array(names, pa.string()).take(pa.array(number))
    columns = [labels, pa.array(values, pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
    entities = pa.StructArray.from_arrays(columns, names=["label", "value", "start", "end"])
    return pa.array(masked, pa.string()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), entities)


def redact_merged(
    df: DataFrame,
    text_col: str,
    types: Sequence[str] | None = None,
    rules: Iterable[Rule] = DEFAULT_RULES,
    dictionary: DataFrame | None = None,
    make_predict: Callable[[], Predict] | None = None,
    answers: str = "json",
    order: Sequence[str] = DETECTORS,
    part_bytes: int = PART_BYTES,
    answer_table: str | None = None,
) -> DataFrame:
    """Mask what rules, word lists and a model find; those that are not given are left out.

    ``order`` names the detectors, the one that wins first. With a model,
    ``failed`` and ``failure`` tell the rows that it has no answer for; these
    are masked by the other detectors alone.
    """
    if set(order) - set(DETECTORS) or len(set(order)) != len(order):
        raise ValueError(f"order may name each of {DETECTORS} once: {order}")
    given = {"rules": True, "lists": dictionary is not None, "model": make_predict is not None}
    columns = [c for c in df.columns if c not in ("redacted_text", "pii_entities")]
    found, spans_cols, told = df, [], []
    # A model is asked first: its answers are what is most costly to have again.
    for detector in sorted((d for d in order if given[d]), key=DETECTORS.index, reverse=True):
        if detector == "rules":
            found = with_segments(found, text_col, select_rules(types, rules))
        elif detector == "lists":
            found = with_list_segments(found, text_col, dictionary, types, (), part_bytes)
        else:
            asked = DEFAULT_TYPES if types is None else types
            if answer_table is not None:
                found = redact_with_table(found, text_col, make_predict, answer_table, asked, answers, only_types=types is not None)
            else:
                found = redact_with(found, text_col, make_predict, asked, answers, only_types=types is not None)
            told = ["failed", "failure"]
        spans_cols.append(f"_spans_{detector}")
        found = found.withColumnRenamed("_segments" if detector != "model" else "pii_entities", spans_cols[-1]).select(
            *[c for c in columns if c not in told], *told, *spans_cols
        )
    best_first = [f"_spans_{d}" for d in order if given[d]]
    return merge_spans(found, text_col, best_first)
