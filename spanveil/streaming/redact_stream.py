"""Structured Streaming form of redaction by rules, word lists or a model.

Detection needs one row at a time, so the stream keeps no state and needs no
watermark: append mode, the same expressions as in batch. What needs a join or a
written table (a long word list, a table of a model's answers) runs on
each micro-batch as a table of its own; such a batch is written to a folder
named by its number, so that a batch that is run again after a restart replaces
what it had written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanveil.operators.lookup import PART_BYTES, list_bytes
from spanveil.plans.jobs import redact_any

# Partition column of output that is written batch by batch.
BATCH = "spanveil_batch"


def read_text_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files under ``path`` as a stream of rows.

    ``files_per_batch`` cuts a large backlog into several micro-batches.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def redact_stream(
    stream: DataFrame,
    output_path: str,
    checkpoint_path: str,
    text_col: str = "text",
    types: Sequence[str] | None = None,
    fmt: str = "parquet",
    until_now: bool = False,
    **detection,
) -> StreamingQuery:
    """Start writing the redacted stream.

    ``detection`` is what `redact_any` takes: rules, a dictionary, a model.

    The file sink and the checkpoint together give each input row once, also
    after a restart. ``until_now`` stops when the present files are done. Read
    the output with `read_redacted`.
    """
    dictionary = detection.get("dictionary")
    by_batch = detection.get("answer_table") is not None or (
        dictionary is not None
        and (detection.get("make_predict") is None or detection.get("order") is not None)
        and list_bytes(dictionary, types) > detection.get("part_bytes", PART_BYTES)
    )
    if by_batch:

        def write(batch: DataFrame, number: int) -> None:
            done = redact_any(batch, text_col, types, **detection)
            done.write.mode("overwrite").format(fmt).save(f"{output_path}/{BATCH}={number}")

        writer = stream.writeStream.foreachBatch(write)
    else:
        found = redact_any(stream, text_col, types, **detection)
        writer = found.writeStream.outputMode("append").format(fmt).option("path", output_path)
    writer = writer.option("checkpointLocation", checkpoint_path)
    if until_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_redacted(spark: SparkSession, output_path: str, fmt: str = "parquet") -> DataFrame:
    """What `redact_stream` has written, in either way."""
    return spark.read.format(fmt).load(output_path).drop(BATCH)
