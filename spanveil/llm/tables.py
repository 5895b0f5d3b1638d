"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from spanveil.sources.shared import fresh_path
from spanveil.sources.tables import read_table, spread

# Bytes of text that an Arrow function handles at a time.
SLICE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", spread(spark))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/pages.parquet", spread(spark))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    This cuts the lineage: what follows survives lost executors and does not
    compute ``df`` again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(
    batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES, fill: bool = True
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ``limit`` bytes in column ``text``.

    A piece has one row at least. With ``fill``, nulls in the text column become
    empty texts.
    """
    for batch in batches:
        column = batch.column(text)
        if column.null_count and fill:
            columns = list(batch.columns)
            columns[text] = column.fill_null("")
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        rows = batch.num_rows
        if not rows:
            continue
        start = 0
        sizes = pa.compute.binary_length(batch.column(text).fill_null("")).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(rows):
            size = int(sizes[i])
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
    # Workers are reused: hand back what Arrow keeps of the large batches.
    pa.default_memory_pool().release_unused()


def filtered(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text (a string column) passes.

    ``make`` is called once per task and returns a function from an array of
    texts (nulls are empty) to an array of booleans. No exchange, and no row is
    held beside the Arrow batch it came in.
    """
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for piece in slices(batches, at, fill=False):
            kept = piece.filter(pa.array(passes(piece.column(at).fill_null(""))))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
