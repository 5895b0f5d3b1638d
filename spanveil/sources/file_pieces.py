"""Large text files in pieces: a file is read by as many tasks as it has splits.

Lines of a split go into pieces of about PIECE_BYTES, each with its place in the
split. Places in the file follow from the sizes of the splits before it. A piece
ends with a line; whether that is a safe end depends on what is looked for, so
each piece has the text around its end, a zone, to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.batches import slices
from spanveil.sources.shared import written

PIECE_BYTES = 1 << 20
# Characters on either side of a piece's end, more where a line is longer.
ZONE_CHARS = 2048

_PIECE = pa.schema(
    [
        ("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("k", pa.int64()), ("before", pa.int64()),
        ("chars", pa.int64()), ("bytes", pa.int64()), ("ends_cr", pa.bool_()), ("text", pa.string()), ("tail", pa.string()),
        ("head", pa.string()), ("following", pa.string()),
    ]
)
_PIECE_DDL = (
    "path string, size long, block long, k long, before long, chars long, bytes long, ends_cr boolean, text string, "
    "tail string, head string, following string"
)


def _tail(text: str, zone: int) -> str:
    """The last lines, ``zone`` characters or more."""
    return text[text.rfind("\n", 0, max(len(text) - zone, 0)) + 1 :]


def _head(text: str, zone: int) -> str:
    end = text.find("\n", zone)
    return text if end < 0 else text[: end + 1]


def read_file_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES, zone: int = ZONE_CHARS) -> DataFrame:
    """Pieces of UTF-8 files with LF, CR LF or CR line ends, which become LF; written once.

    ``path, start`` (code points before the piece), ``chars``, ``text``, and
    ``block, k``, by which the pieces of a file are ordered; ``zone``, the text
    around the piece's end, and ``cut``, where in it the end is (null for the last
    piece). A piece has ``zone`` characters or more, but for the last of a split.
    Bytes that are no UTF-8 become U+FFFD. Compressed files are one split;
    empty ones have no piece. A line is never divided: the longest has to fit a row.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.octet_length("value").alias("bytes"),
        F.make_valid_utf8("value").alias("value"),
    )

    def made(where: tuple, last: dict | None, held: list[str], taken: int) -> dict:
        raw = "\n".join(held) + "\n"
        text = raw.replace("\r\n", "\n").replace("\r", "\n")
        k, before, earlier = (last["k"] + 1, last["before"] + last["chars"], last["tail"]) if last else (0, 0, "")
        ends = _tail(earlier + text if len(text) < zone else text, zone), _head(text, zone)
        row = (*where, k, before, len(text), taken, held[-1].endswith("\r"), text, *ends, None)
        return dict(zip(_PIECE.names, row))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``last`` waits for the piece behind it, whose head it takes along.
        where, last, held, taken, chars = None, None, [], 0, 0
        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for *here, length, value in zip(*columns):
                if held and (here != where or (taken + length > piece_bytes and chars >= zone)):
                    piece = made(where, last, held, taken)
                    if last:
                        last["following"] = piece["head"]
                        yield pa.RecordBatch.from_pylist([last], schema=_PIECE)
                    last, held, taken, chars = piece, [], 0, 0
                if here != where and last:
                    yield pa.RecordBatch.from_pylist([last], schema=_PIECE)
                    last = None
                where = here
                held.append(value)
                taken += length + 1
                chars += len(value) + 1
        if held:
            piece = made(where, last, held, taken)
            if last:
                last["following"] = piece["head"]
                yield pa.RecordBatch.from_pylist([last], schema=_PIECE)
            last = piece
        if last:
            yield pa.RecordBatch.from_pylist([last], schema=_PIECE)

    return _placed(written(lines.mapInArrow(pack, _PIECE_DDL), "pieces"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with their place in the file, the text around their end, and the file's own first and last characters.

    Only sizes and the texts around the ends of splits are ordered, a row per split.
    """
    order = "PARTITION BY path ORDER BY block"
    # The reader ends every line and skips a byte order mark, which the size counts: so many bytes too many.
    surplus = "sum(bytes) OVER (PARTITION BY path) - size"
    known = (
        pieces.groupBy("path", "block")
        .agg(
            F.any_value("size").alias("size"),
            F.sum("chars").alias("chars"),
            F.sum("bytes").alias("bytes"),
            F.max_by("ends_cr", "k").alias("ends_cr"),
            F.min_by("head", "k").alias("head"),
        )
        .select(
            "path",
            "block",
            F.expr(f"coalesce(sum(chars) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("offset"),
            F.expr(f"lead(head) OVER ({order})").alias("next_head"),
            F.expr(f"{surplus} IN (1, -2) AND NOT ends_cr").alias("open"),
            F.expr(f"if({surplus} IN (-3, -2), 1, 0)").alias("mark"),
        )
    )
    after = F.coalesce("following", "next_head")
    shorter = after.isNull() & F.col("open")
    first = (F.col("offset") + F.col("before") == 0) & (F.col("mark") == 1)
    text = F.when(shorter, F.left("text", (F.col("chars") - 1).cast("int"))).otherwise(F.col("text"))
    return pieces.join(known, ["path", "block"]).select(
        "path",
        "block",
        "k",
        (F.col("offset") + F.col("before") + F.when(first, 0).otherwise(F.col("mark"))).alias("start"),
        (F.col("chars") - F.when(shorter, 1).otherwise(0) + F.when(first, 1).otherwise(0)).alias("chars"),
        F.when(first, F.concat(F.lit("\ufeff"), text)).otherwise(text).alias("text"),
        F.concat("tail", after).alias("zone"),
        F.when(after.isNotNull(), F.char_length("tail")).alias("cut"),
    )
