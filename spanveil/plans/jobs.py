"""The jobs a user runs: redact files or a corpus, score results, prepare training data."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.answer_table import redact_with_table
from spanveil.operators.answers import Predict, redact_with
from spanveil.operators.detect import redact
from spanveil.operators.limits import head_n
from spanveil.operators.lookup import PART_BYTES, redact_with_lists
from spanveil.operators.merge import redact_merged
from spanveil.operators.rules import DEFAULT_RULES, DEFAULT_TYPES, Rule
from spanveil.operators.score import score, score_with_labels
from spanveil.operators.training_text import MAX_LENGTH, WHITESPACE_TOKENIZER, Tokenizer, sft_labels
from spanveil.sources.corpus import corpus_output, head_per_split, read_corpus
from spanveil.sources.file_pieces import PIECE_BYTES, ZONE_CHARS, read_file_pieces
from spanveil.sources.results import read_results, write_results
from spanveil.sources.shared import written
from spanveil.sources.text_files import read_text_files
from spanveil.sources.type_list import choose_types

_log = logging.getLogger(__name__)


def redact_any(
    df: DataFrame,
    text_col: str,
    types: Sequence[str] | None = None,
    rules: Iterable[Rule] = DEFAULT_RULES,
    dictionary: DataFrame | None = None,
    make_predict: Callable[[], Predict] | None = None,
    answers: str = "json",
    part_bytes: int = PART_BYTES,
    answer_table: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Rules by default, with word lists when given, or a caller's model instead.

    Without ``types``, all rules and all listed labels apply, and a model is
    asked for the default types. A list of more than ``part_bytes`` is joined.
    With ``answer_table``, a path, answers are kept there and not asked for twice.
    With ``order``, rules, lists and the model are all used, and their spans are
    merged in this order.
    """
    rules = tuple(rules)
    if order is not None:
        return redact_merged(df, text_col, types, rules, dictionary, make_predict, answers, order, part_bytes, answer_table)
    if make_predict is not None:
        asked = DEFAULT_TYPES if types is None else types
        if answer_table is not None:
            return redact_with_table(df, text_col, make_predict, answer_table, asked, answers)
        return redact_with(df, text_col, make_predict, asked, answers)
    if types is not None:
        known = {r.label for r in rules}
        if dictionary is not None:
            known |= {r[0] for r in dictionary.select("label").where(F.col("label").isin(list(types))).distinct().collect()}
        if missing := [t for t in types if t not in known]:
            _log.warning("no rule and no list finds these types: %s", ", ".join(missing))
    if dictionary is not None:
        return redact_with_lists(df, text_col, dictionary, types, rules, part_bytes)
    return redact(df, text_col, types, rules)


def _asked_types(spark: SparkSession, types: Sequence[str] | None, types_file: str | None) -> list[str] | None:
    """None when the caller names no types: then nothing is left out."""
    return None if types is None and types_file is None else choose_types(spark, types, types_file)


def _written(result: DataFrame, path: str | None, fmt: str) -> DataFrame:
    """The result itself, or a read of what was written: no second run of a detection or a model."""
    if path is None:
        return result
    write_results(result, path, fmt)
    return result.sparkSession.read.schema(result.schema).format(fmt).load(path)


def redact_corpus(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    limit: int | None = None,
    types: Sequence[str] | None = None,
    types_file: str | None = None,
    input_format: str = "parquet",
    output_format: str = "json",
    **detection,
) -> DataFrame:
    """Redact the ``source_text`` of a corpus; eleven columns.

    With ``output_path`` they are written, and what comes back is what was
    written. ``limit`` comes before detection, and rows past it are not read.
    """
    corpus = head_n(read_corpus(spark, input_path, input_format), "id", limit)
    chosen = _asked_types(spark, types, types_file)
    return _written(corpus_output(redact_any(corpus, "source_text", chosen, **detection)), output_path, output_format)


def redact_files(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    types: Sequence[str] | None = None,
    types_file: str | None = None,
    output_format: str = "json",
    **detection,
) -> DataFrame:
    """Redact whole text files, one row per file: original text, masked text, entities."""
    files = read_text_files(spark, input_path)
    chosen = _asked_types(spark, types, types_file)
    result = redact_any(files, "original_text", chosen, **detection).select("original_text", "redacted_text", "pii_entities")
    return _written(result, output_path, output_format)


def redact_large_files(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    types: Sequence[str] | None = None,
    types_file: str | None = None,
    output_format: str = "json",
    piece_bytes: int = PIECE_BYTES,
    zone: int = ZONE_CHARS,
    **detection,
) -> DataFrame:
    """Redact text files of any size: ``path, start, chars, redacted_text, pii_entities``, a row per piece.

    Pieces in order of ``start`` give the masked file, and the entities, whose
    offsets are those in the file, are the ones that `redact_files` finds. A
    piece ends with a line. Where an entity reaches across such an end, as ``zone``
    characters on either side show, the pieces are joined first.
    """
    chosen = _asked_types(spark, types, types_file)
    pieces = read_file_pieces(spark, input_path, piece_bytes, zone)
    zones = redact_any(pieces.where("zone IS NOT NULL").select("path", "block", "k", "zone", "cut"), "zone", chosen, **detection)
    crossed = zones.where("exists(pii_entities, s -> s.start < cut AND s.end > cut)").select("path", "block", "k")
    joined = _across(pieces.drop("zone", "cut"), written(crossed, "crossed"))
    found = redact_any(joined, "text", chosen, **detection)
    placed = F.transform(
        "pii_entities",
        lambda s: F.struct(s["label"], s["value"], (F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"]).alias("end")),
    )
    result = found.select("path", "start", "chars", "redacted_text", placed.alias("pii_entities"))
    return _written(result, output_path, output_format)


def _across(pieces: DataFrame, crossed: DataFrame) -> DataFrame:
    """Pieces, those with an unsafe end joined with the ones behind them."""
    if crossed.isEmpty():
        return pieces.select("path", "start", "chars", "text")
    # Numbers and marks alone are ordered; texts are brought together only where ends are unsafe.
    marked = pieces.select("path", "block", "k").join(crossed.withColumn("unsafe", F.lit(1)), ["path", "block", "k"], "left")
    order = "PARTITION BY path ORDER BY block, k"
    begins = marked.withColumn("begins", F.expr(f"if(lag(unsafe) OVER ({order}) = 1, 0, 1)"))
    runs = begins.withColumn("run", F.expr(f"sum(begins) OVER ({order})"))
    runs = runs.withColumn("alone", F.expr("count(*) OVER (PARTITION BY path, run) = 1"))
    staged = pieces.join(runs.select("path", "block", "k", "run", "alone"), ["path", "block", "k"])
    parts = F.array_sort(F.collect_list(F.struct("block", "k", "text")))
    several = (
        staged.where("NOT alone")
        .groupBy("path", "run")
        .agg(F.min("start").alias("start"), F.sum("chars").alias("chars"), parts.alias("parts"))
        .select("path", "start", "chars", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )
    return staged.where("alone").select("path", "start", "chars", "text").unionByName(several)


def score_results(
    spark: SparkSession,
    path: str,
    per_label: bool = False,
    ignore_labels: bool = False,
    fmt: str = "json",
    array_file: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Overall scores of saved results, and scores per label on request; the results are read once."""
    results = read_results(spark, path, fmt, array_file)
    columns = ("pii_entities", "original_privacy_mask", ignore_labels)
    return score_with_labels(results, *columns) if per_label else (score(results, *columns), None)


def training_set(
    corpus: DataFrame,
    train_rows: int = 1000,
    validation_rows: int = 100,
    tokenizer: Tokenizer = WHITESPACE_TOKENIZER,
    pad_id: int = 0,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Tokenized examples of the head of both splits, with ``id`` and ``set`` kept."""
    head = head_per_split(corpus, train_rows, validation_rows)
    return sft_labels(head, ("id", "set"), tokenizer=tokenizer, pad_id=pad_id, max_length=max_length)
