"""Text helpers that follow Python's string rules inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind

# Every code point that Python's str.strip() removes; the last one is U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode whitespace included."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalise_newlines(col: Column) -> Column:
    """Turn CR LF and lone CR into LF, as a text-mode read in Python does."""
    return F.regexp_replace(col, "\r\n?", "\n")


def find(text: str, value: str) -> str:
    """0-based index of the first occurrence of ``value``, null when absent.

    An empty value is found at 0 in any text. SQL text in and out.
    """
    index = bind(f"position({value}, {text})", "hit", "if(hit > 0, hit - 1, null)")
    return f"CASE WHEN {value} = '' THEN 0 ELSE {index} END"
