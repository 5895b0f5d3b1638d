"""Prompt and response text for model training, with token ids and label masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import name


# The training template, the sequence length and the ignore mark.
TRAINING_PREFIX = (
    "<|system|>\nYou are a data redaction assistant. You redact PII in the input below and return only "
    "the redacted text. Do not explain anything.\n<|user|>\n{source}\n<|assistant|>\n"
)
MAX_LENGTH = 512
IGNORED = -100

def prompt_prefix(source: Column) -> Column:
    before, after = TRAINING_PREFIX.split("{source}")
    return F.concat(F.lit(before), source, F.lit(after))


def training_text(source: Column, target: Column) -> Column:
    return F.concat(prompt_prefix(source), target)


@dataclass(frozen=True)
class Tokenizer:
    """Ids of the first ``limit`` tokens of a text column, and how many there are.

    ``count`` may be cheaper than counting the ids. ``both``, where it is given,
    takes a text and a prompt column and has ``ids`` of the one and ``count`` of
    the other in one struct.
    """

    ids: Callable[[str, int], Column]
    count: Callable[[str, int], Column]
    both: Callable[[str, str, int], Column] | None = None


def _words(text_col: str, limit: int) -> str:
    # The split stops after the words that are wanted; one more piece for an
    # empty one in front, one for the unsplit rest, which is dropped.
    pieces = f"slice(split({name(text_col)}, '[ \\t\\r\\n]+', {limit + 2}), 1, {limit + 1})"
    return f"slice(filter({pieces}, w -> w <> ''), 1, {limit})"


# Whitespace-separated words; an id is 1 plus 28 bits of the word's digest.
WHITESPACE_TOKENIZER = Tokenizer(
    ids=lambda text, limit: F.expr(
        f"transform({_words(text, limit)}, w -> CAST(conv(left(md5(w), 7), 16, 10) AS INT) + 1)"
    ),
    count=lambda text, limit: F.expr(f"size({_words(text, limit)})"),
)


def python_tokenizer(make_encode: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]) -> Tokenizer:
    """A tokenizer from a Python encoder, made once per task and called once per Arrow batch, prompts behind texts."""

    def ids(text_col: str, limit: int) -> Column:
        @F.arrow_udf("array<int>")
        def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = make_encode()
            for texts in batches:
                yield pa.array([list(i)[:limit] for i in encode(texts.to_pylist())], pa.list_(pa.int32()))

        return encode_batches(F.col(text_col))

    def both(text_col: str, prompt_col: str, limit: int) -> Column:
        @F.arrow_udf("ids array<int>, count int")
        def encode_pairs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            encode = make_encode()
            for texts, prompts in batches:
                encoded = encode(texts.to_pylist() + prompts.to_pylist())
                found = pa.array([list(i)[:limit] for i in encoded[: len(texts)]], pa.list_(pa.int32()))
                counts = pa.array([min(len(i), limit) for i in encoded[len(texts) :]], pa.int32())
                yield pa.StructArray.from_arrays([found, counts], names=["ids", "count"])

        return encode_pairs(F.col(text_col), F.col(prompt_col))

    return Tokenizer(ids=ids, count=lambda text, limit: F.size(ids(text, limit)), both=both)


def sft_examples(df: DataFrame, source_col: str = "source_text", target_col: str = "target_text") -> DataFrame:
    """Append ``prompt`` (without the answer) and ``text`` (with it)."""
    return df.withColumns(
        {
            "prompt": prompt_prefix(F.col(source_col)),
            "text": training_text(F.col(source_col), F.col(target_col)),
        }
    )


def sft_labels(
    df: DataFrame,
    keep: Sequence[str] = ("id",),
    source_col: str = "source_text",
    target_col: str = "target_text",
    tokenizer: Tokenizer = WHITESPACE_TOKENIZER,
    pad_id: int = 0,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Token ids, attention mask and labels of fixed length, plus the ``keep`` columns.

    Ids are cut and padded to ``max_length``. The labels are the ids, except
    that the prompt and every pad token are ignored; where the pad token is also
    the end token, real end tokens are ignored as well.
    """
    examples = sft_examples(df, source_col, target_col)
    if tokenizer.both is not None:
        pairs = examples.select(*keep, tokenizer.both("text", "prompt", max_length).alias("_pair"))
        encoded = pairs.select(*keep, F.col("_pair.ids").alias("_ids"), F.col("_pair.count").alias("_prefix"))
    else:
        encoded = examples.select(
            *keep,
            tokenizer.ids("text", max_length).alias("_ids"),
            tokenizer.count("prompt", max_length).alias("_prefix"),
        )
    missing = f"{max_length} - size(_ids)"
    padded = encoded.select(
        *keep,
        F.expr(f"concat(_ids, array_repeat({pad_id}, {missing}))").alias("input_ids"),
        F.expr(f"concat(array_repeat(1, size(_ids)), array_repeat(0, {missing}))").alias("attention_mask"),
        "_prefix",
    )
    labels = f"transform(input_ids, (token, i) -> if(i < _prefix OR token = {pad_id}, {IGNORED}, token))"
    return padded.select(*keep, "input_ids", "attention_mask", F.expr(labels).alias("labels"))
