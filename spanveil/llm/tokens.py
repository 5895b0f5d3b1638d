"""Token counts, and encoding and decoding, of whole texts.

Both walk the texts in Arrow batches and shuffle nothing. The tokenizer file is
read where the caller is and travels to the tasks as a broadcast value; its size
is that of the vocabulary, whatever the texts.

Nulls count as empty texts: no tokens, an empty id list, an empty decoded text.
Rows keep their number; repeated rows give repeated results. An empty table
gives an empty table. Only the named columns are read, so others may have any
name. A very long text is one row's work; its words are merged one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.bpe import STORE, Tokenizer, newer_letters
from spanveil.llm.tables import slices


class Kept(dict):
    """Results per word; computed when first asked for, emptied when full."""

    def __init__(self, compute: Callable, known: dict | None = None) -> None:
        super().__init__(known or {})
        self.compute = compute
        self.known = known or {}

    def __missing__(self, word: str):
        if len(self) >= STORE + len(self.known):
            self.clear()
            self.update(self.known)
        self[word] = found = self.compute(word)
        return found


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """Id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every text.

    The whole-token shortcut: once, before any text is read, each vocabulary
    string is put through pre-token pattern and merges. Those that come back as
    one token are known to count one wherever they stand as a pre-token. Only
    other pre-tokens are merged, each once per task while the store has room.
    """
    spark = docs.sparkSession
    file = file_bytes(path)
    newer = newer_letters()
    shared = spark.sparkContext.broadcast((file, newer, Tokenizer(file, newer).whole_words()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, letters, whole = shared.value
        tokenizer = Tokenizer(raw, letters)
        size = Kept(lambda word: len(tokenizer.encode_word(word)), dict.fromkeys(whole, 1))
        for piece in slices(batches, 2):
            counts = []
            for text in piece.column(2).to_pylist():
                n = 0
                for words, special in tokenizer.pieces(text):
                    n += sum(map(size.__getitem__, words)) + (special is not None)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("_text"),
    )
    return rows.mapInArrow(counted, f"_id {id_type}, n_bytes long, n_tokens long").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=bounds[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))


def _encoded(tokenizer: Tokenizer) -> Callable[[pa.Array], pa.ListArray]:
    kept = Kept(tokenizer.encode_word)

    def of(text: str) -> np.ndarray:
        ids: list = []
        for words, special in tokenizer.pieces(text):
            ids.extend(map(kept.__getitem__, words))
            if special is not None:
                ids.append((special,))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32)

    return lambda texts: _lists([of(text) for text in texts.to_pylist()])


def _decoded(tokenizer: Tokenizer) -> Callable[[pa.ListArray], pa.Array]:
    names = pa.array([x or "" for x in tokenizer.names], pa.string())
    known = pa.array([x is not None for x in tokenizer.names])

    def decode(ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten()
        if flat.null_count or len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(names):
            raise ValueError("an id is not in the vocabulary")
        if not pc.all(known.take(flat), min_count=0).as_py():
            raise ValueError("an id is not in the vocabulary")
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), names.take(flat)), " ")

    return decode


def _tokens(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast((file_bytes(path), newer_letters()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids`` (array of int): every text, encoded without added special tokens."""
    shared = _tokens(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _encoded(Tokenizer(*shared.value))
        for piece in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([piece.column(0), encoded(piece.column(1))], names=["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``decoded``: the tokens' strings, joined by a space; null ids give an empty text."""
    shared = _tokens(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoded(Tokenizer(*shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded(batch.column(1))], names=["_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    id_type = encoded.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, decoded string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` and ``decoded``: `encode`, then `decode`, in one pass over the texts."""
    shared = _tokens(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*shared.value)
        encoded, decoded = _encoded(tokenizer), _decoded(tokenizer)
        for piece in slices(batches, 1):
            ids = encoded(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), ids, decoded(ids)], names=["_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
