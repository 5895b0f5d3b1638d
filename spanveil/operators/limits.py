"""Head of a table in id order, by selection: no id is sorted, exchanged or written.

Which id is the n-th is found by narrowing the range that holds it. A pass over
the id column counts the ids per part of the range (equal widths for whole
numbers, dates and times, the next character for strings), each task its own, and
the part that holds the n-th is the next range, until it is small enough to be
looked at. The id then becomes a filter that reaches the scan.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.text import name

# Parts that a range is cut into, and distinct ids that the driver looks at in the end.
BUCKETS = 4096
FEW = 4096

# The last id wanted, the rows with smaller ids, the rows with this id.
Last = tuple[Column, int, int]


def _walked(counts: list[tuple], n: int) -> tuple:
    """The entry that holds the n-th row, the rows before it, and its own."""
    below = 0
    for key, count in sorted(counts, key=lambda c: c[0]):
        if below + count >= n:
            return key, below, count
        below += count
    raise AssertionError("fewer rows than were counted before")


def _counted(rows: DataFrame, key: Column) -> list[tuple]:
    return [(r[0], r[1]) for r in rows.groupBy(key.alias("k")).count().collect()]


def _last_number(ids: DataFrame, as_number: str, as_id: str, n: int) -> Last | None:
    """The n-th id by whole numbers; ``as_number`` and ``as_id`` are SQL with ``{}`` for the value."""
    number = as_number.format("_id")
    count, low, high = ids.selectExpr(f"{number} AS x").agg(F.count("x"), F.min("x"), F.max("x")).first()
    if count < n:
        return None

    def here() -> DataFrame:
        """The range, as a filter on the column itself."""
        return ids.where(f"_id >= {as_id.format(f'({low}L)')} AND _id <= {as_id.format(f'({high}L)')}")

    below = 0
    while min(count, high - low + 1) > FEW:
        width = -(-(high - low + 1) // BUCKETS)
        # Decimals, as the difference of two longs need not fit one.
        bucket = F.expr(f"(cast({number} AS decimal(20)) - ({low}BD)) div {width}BD")
        at, before, count = _walked(_counted(here(), bucket), n - below)
        below += before
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    last, before, same = _walked(_counted(here(), F.expr(number)), n - below)
    return F.expr(as_id.format(f"({last}L)")), below + before, same


def _last_string(ids: DataFrame, n: int) -> Last | None:
    """The n-th id by its characters: counts per next character, behind what all ids of the range begin with."""
    count, low, high = ids.agg(F.count("_id"), F.min("_id"), F.max("_id")).first()
    if count < n:
        return None
    below, here = 0, ids
    while low != high and count > FEW:
        following = F.substring("_id", len(commonprefix([low, high])) + 1, 1)
        parts = here.groupBy(following.alias("c")).agg(F.count("*"), F.min("_id"), F.max("_id"))
        found = {r[0]: r for r in parts.collect()}
        char, before, count = _walked([(c, r[1]) for c, r in found.items()], n - below)
        below += before
        low, high = found[char][2], found[char][3]
        here = ids.where((F.col("_id") >= F.lit(low)) & (F.col("_id") <= F.lit(high)))
    last, before, same = _walked(_counted(here, F.col("_id")), n - below)
    return F.lit(last), below + before, same


def last_id(ids: DataFrame, n: int) -> Last | None:
    """The n-th of the ids (column ``_id``, no nulls) in order; None if there are fewer."""
    kind = ids.schema["_id"].dataType
    if isinstance(kind, T.IntegralType):
        return _last_number(ids, "cast({} AS long)", f"cast({{}} AS {kind.simpleString()})", n)
    if isinstance(kind, T.DateType):
        return _last_number(ids, "cast(unix_date({}) AS long)", "date_from_unix_date(cast({} AS int))", n)
    if isinstance(kind, T.TimestampType):
        return _last_number(ids, "unix_micros({})", "timestamp_micros({})", n)
    if kind == T.StringType():
        return _last_string(ids, n)
    raise TypeError(f"no head by ids of type {kind.simpleString()}: use whole numbers, strings, dates or times")


def head_n(df: DataFrame, id_col: str, n: int | None) -> DataFrame:
    """The ``n`` rows with the smallest ids; all rows for None or 0, none below 0.

    Rows that share the last id are counted, so exactly ``n`` rows come back.
    Rows without an id come after all others. Texts past the limit are never
    read. Ids are whole numbers, strings, dates or times.
    """
    if not n:
        return df
    if n < 0:
        return df.limit(0)
    key = F.col(name(id_col))
    known = df.filter(key.isNotNull())
    cut = last_id(known.select(key.alias("_id")), n)
    if cut is None:
        missing = n - known.count()
        return known.unionByName(df.filter(key.isNull()).limit(missing)) if missing else known
    last, below, same = cut
    if below + same == n:
        return df.filter(key <= last)
    return df.filter(key < last).unionByName(df.filter(key == last).limit(n - below))
