"""Detection by word lists, for names and places that no pattern can find.

Lists apply to the plain segments that the rules left, so rule and list
entities never overlap. A term is one word or several; it matches whole words in
any letter case, with any white space between them, the longest term first.

Runs of words are hashed as arrays, for each number of words that a term has.
Where the hash is that of a term, both are compared as text, so a segment costs
as much as it has words, whatever the list. How hashes meet depends on the
list's size, which is measured first:

- up to PART_BYTES, the list travels to the tasks as flat arrays. No text is
  exchanged and nothing is joined, so the same expressions run on a stream;
- beyond that, places and hashes go out without text and are joined with the
  list on Spark, and the terms found come back, grouped per row. The list is
  never on the driver; it gets a bit map of fixed size, the lengths of terms and
  the few hashes that are hot. This needs a written table and a join, so a
  stream takes it batch by batch (`spanveil.streaming.redact_stream`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.batches import list_starts, slices
from spanveil.functions.bit_map import bit_map, may_hold
from spanveil.functions.text import quoted
from spanveil.functions.word_runs import WORD_CLASS, Words, WordRuns, character_tables
from spanveil.operators.detect import add_redaction, with_segments
from spanveil.operators.rules import DEFAULT_RULES, Rule, select_rules
from spanveil.sources.shared import written

PART_BYTES = 32 << 20
# Characters that a task turns into arrays at a time; a longer segment is one such piece.
PIECE_CHARS = 1 << 20
# Copies of a hot term in the join.
SALTS = 16
# Runs of words whose label a task remembers.
KNOWN_RUNS = 1 << 14

_SEGMENTS_DDL = "array<struct<piece: string, label: string>>"
_SEGMENTS_ARROW = pa.struct([("piece", pa.string()), ("label", pa.string())])


def _terms(dictionary: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """``key`` (words joined by a space, lower case) with the first of its labels, and ``bad``, a term that is none."""
    wanted = dictionary if types is None else dictionary.filter(F.col("label").isin(list(types)))
    words = f"array_join(regexp_extract_all(term, {quoted(f'[{WORD_CLASS}]+')}, 0), ' ')"
    # (?U) lets white space mean that of Unicode, as between the words of a text.
    spaced = f"trim(regexp_replace(term, {quoted(r'(?U)\s+')}, ' '))"
    return (
        wanted.selectExpr("label", f"{words} AS words", f"if({spaced} <> {words} OR {words} = '', term, NULL) AS bad")
        .groupBy(F.expr("lower(words)").alias("key"))
        .agg(F.min("label").alias("label"), F.max("bad").alias("bad"))
    )


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about PIECE_CHARS characters."""
    first, room = 0, PIECE_CHARS
    for i, text in enumerate(texts):
        if i > first and len(text) > room:
            yield first, i
            first, room = i, PIECE_CHARS
        room -= len(text)
    if texts:
        yield first, len(texts)


def _plain(segments: pa.ListArray) -> tuple[np.ndarray, list[str]]:
    """Places in the flat segments, and pieces, of those without a label."""
    flat = segments.flatten()
    at = np.flatnonzero(np.asarray(flat.field("label").is_null()))
    return at, flat.field("piece").take(pa.array(at)).fill_null("").to_pylist()


def _run_text(piece: str, words: Words, first: int, last: int) -> str:
    """A run of words as a term's key is written."""
    return " ".join(piece[words.start[i] : words.end[i]].lower() for i in range(first, last + 1))


def _cut(segments: pa.ListArray, hits: dict[int, list[tuple[int, int, str]]]) -> pa.ListArray:
    """Segments cut at the hits (start, -end, label) of their flat places: from left to right, the longest where several begin."""
    if not hits:
        return segments
    flat = segments.flatten()
    pieces, labels = flat.field("piece").to_pylist(), flat.field("label").to_pylist()
    out_pieces, out_labels = [], []
    grown = np.zeros(len(pieces), dtype=np.int64)
    done = 0
    for k in sorted(hits):
        out_pieces += pieces[done:k]
        out_labels += labels[done:k]
        piece, at, before = pieces[k], 0, len(out_pieces)
        for start, end, label in sorted(hits[k]):
            if start >= at:
                out_pieces += [piece[at:start], piece[start:-end]]
                out_labels += [None, label]
                at = -end
        out_pieces.append(piece[at:])
        out_labels.append(None)
        grown[k] = len(out_pieces) - before - 1
        done = k + 1
    out_pieces += pieces[done:]
    out_labels += labels[done:]
    starts = list_starts(segments)
    starts = starts + np.concatenate([[0], np.cumsum(grown)])[starts]
    values = pa.StructArray.from_arrays([pa.array(out_pieces, pa.string()), pa.array(out_labels, pa.string())], fields=list(_SEGMENTS_ARROW))
    offsets = pa.array(starts.astype(np.int32), mask=np.append(np.asarray(segments.is_null()), False))
    return pa.ListArray.from_arrays(offsets, values)


def _flat_list(terms: DataFrame, lengths: Sequence[int]) -> tuple:
    """A short list as plain arrays: lengths, sorted hashes, keys and where they begin, labels by number."""
    table = terms.select("key", "label").toArrow()
    keys, labels = table["key"].to_pylist(), table["label"].to_pylist()
    hashes = WordRuns(*character_tables()).term_hashes(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    encoded = [keys[i].encode() for i in order]
    begins = np.concatenate([[0], np.cumsum([len(k) for k in encoded], dtype=np.int64)])
    names = sorted(set(labels))
    numbers = {name: i for i, name in enumerate(names)}
    codes = np.array([numbers[labels[i]] for i in order], dtype=np.int32)
    return list(lengths), hashes[order], b"".join(encoded), begins, codes, names


def _cut_at_terms(shared, tables) -> Callable:
    """Segments cut at the terms of a short list."""

    @F.arrow_udf(_SEGMENTS_DDL)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths, hashes, blob, begins, codes, names = shared.value
        runs = WordRuns(*tables)
        # Labels of runs that were compared as text before; how a run reads tells its words.
        labels: dict[str, str | None] = {}
        missing = object()

        def label_of(key: bytes, k: int, wanted: np.uint64) -> str | None:
            while k < len(hashes) and hashes[k] == wanted:
                if blob[begins[k] : begins[k + 1]] == key:
                    return names[codes[k]]
                k += 1
            return None

        for segments in slices(batches):
            at, texts = _plain(segments)
            hits: dict[int, list] = {}
            for low, high in _pieces(texts) if len(hashes) else ():
                words = runs.words(texts[low:high])
                for first, last, found in runs.of_lengths(words, lengths):
                    place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[place] == found)
                    of, begin, end = low + words.text[first[hit]], words.start[first[hit]], words.end[last[hit]]
                    for i, text, a, b, flat in zip(hit.tolist(), of.tolist(), begin.tolist(), end.tolist(), at[of].tolist()):
                        run = texts[text][a:b]
                        if (label := labels.get(run, missing)) is missing:
                            if len(labels) == KNOWN_RUNS:
                                labels.clear()
                            key = _run_text(texts[text], words, first[i], last[i]).encode()
                            label = labels[run] = label_of(key, int(place[i]), found[i])
                        if label is not None:
                            hits.setdefault(flat, []).append((a, -b, label))
            yield _cut(segments, hits)

    return cut


def _hashed(terms: DataFrame) -> DataFrame:
    """``hash, n, key, label`` of a long list's terms, written once."""
    tables = character_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = WordRuns(*tables)
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            sizes = pa.array([k.count(" ") + 1 for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.term_hashes(keys).view(np.int64)), sizes, *batch.columns], names=["hash", "n", "key", "label"]
            )

    return written(terms.select("key", "label").mapInArrow(run, "hash long, n int, key string, label string"), "list-terms")


def _likely_runs(staged: DataFrame, lengths: Sequence[int], bits: np.ndarray) -> DataFrame:
    """``hash, row, segment, start, end`` of the runs of words whose hash the bit map knows; no text. Written once."""
    spark = staged.sparkSession
    tables, shared = character_tables(), spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, known = WordRuns(*tables), shared.value
        for batch in slices(batches):
            rows, segments = np.asarray(batch.column(0)), batch.column(1)
            at, texts = _plain(segments)
            starts = list_starts(segments)
            for low, high in _pieces(texts):
                words = runs.words(texts[low:high])
                for first, last, found in runs.of_lengths(words, lengths):
                    hit = may_hold(known, found)
                    first, last, found = first[hit], last[hit], found[hit]
                    flat = at[low + words.text[first]]
                    row = np.searchsorted(starts, flat, "right") - 1
                    columns = (found.view(np.int64), rows[row], flat - starts[row], words.start[first], words.end[last])
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(_RUN_COLUMNS))

    schema = ", ".join(f"{c} long" for c in _RUN_COLUMNS)
    return written(staged.select("_row", "_segments").mapInArrow(run, schema), "list-runs")


_RUN_COLUMNS = ("hash", "row", "segment", "start", "end")


def _joined(runs: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms found, grouped per row: ``_row, _found``. Runs and terms meet by hash; hot hashes are spread by row.

    A hash is hot with more than its share of half a partition, so there are
    twice as many of them as partitions at most.
    """
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = runs.count() // (2 * partitions)
    hot = [r[0] for r in runs.groupBy("hash").count().where(F.col("count") > share).select("hash").collect()]
    is_hot = F.col("hash").isin(hot)
    spread = runs.withColumn("salt", F.when(is_hot, F.pmod("row", F.lit(SALTS))).otherwise(0))
    copies = terms.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    copies = copies.withColumn("salt", F.col("salt").cast("long"))
    found = spread.join(copies.drop("n"), ["hash", "salt"])
    return found.groupBy(F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("segment", "start", "end", "label", "key")).alias("_found")
    )


def _cut_at_found() -> Callable:
    """Segments cut at the terms that the join found, where the text is indeed the term."""

    @F.arrow_udf(_SEGMENTS_DDL)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        word = regex.compile(f"[{WORD_CLASS}]+")
        for segments, found in slices(batches):
            terms = found.flatten()
            row = np.repeat(np.arange(len(found)), np.diff(list_starts(found)))
            at, of = np.unique(list_starts(segments)[row] + np.asarray(terms.field("segment")), return_inverse=True)
            texts = segments.flatten().field("piece").take(pa.array(at)).to_pylist()
            hits: dict[int, list] = {}
            columns = (terms.field(c).to_pylist() for c in ("start", "end", "label", "key"))
            for k, start, end, label, key in zip(of.tolist(), *columns):
                if " ".join(w.lower() for w in word.findall(texts[k][start:end])) == key:
                    hits.setdefault(int(at[k]), []).append((start, -end, label))
            yield _cut(segments, hits)

    return cut


def list_bytes(dictionary: DataFrame, types: Sequence[str] | None = None) -> int:
    """What the chosen terms take, as measured before a list travels. Bad terms are refused here."""
    size = F.sum(F.octet_length("key") + F.octet_length("label"))
    total, bad = _terms(dictionary, types).agg(size, F.max("bad")).first()
    if bad is not None:
        raise ValueError(f"a dictionary term may hold words and spaces only: {bad!r}")
    return total or 0


def redact_with_lists(
    df: DataFrame,
    text_col: str,
    dictionary: DataFrame,
    types: Sequence[str] | None = None,
    rules: Iterable[Rule] = DEFAULT_RULES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Mask rule matches and listed terms; adds ``redacted_text`` and ``pii_entities``.

    ``dictionary`` has the columns ``term`` and ``label``. Of several labels of a
    term the first in order counts. A list of more than ``part_bytes`` is joined.
    """
    return add_redaction(with_list_segments(df, text_col, dictionary, types, rules, part_bytes))


def with_list_segments(
    df: DataFrame,
    text_col: str,
    dictionary: DataFrame,
    types: Sequence[str] | None = None,
    rules: Iterable[Rule] = DEFAULT_RULES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Append ``_segments``, the text cut at rule matches and listed terms."""
    spark = df.sparkSession
    terms = _terms(dictionary, types)
    size = list_bytes(dictionary, types)
    columns = [c for c in df.columns if c not in ("redacted_text", "pii_entities")]
    staged = with_segments(df, text_col, select_rules(types, rules)).select(*columns, "_segments")
    if size > part_bytes:
        if df.isStreaming:
            raise ValueError("a long list is joined batch by batch: write the stream with redact_stream")
        return _with_long_list(staged, columns, terms)
    if size:
        lengths = [r[0] for r in terms.select(F.size(F.split("key", " "))).distinct().collect()]
        shared = spark.sparkContext.broadcast(_flat_list(terms, lengths))
        staged = staged.select(*columns, _cut_at_terms(shared, character_tables())("_segments").alias("_segments"))
    return staged


def _with_long_list(staged: DataFrame, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    # Written, so that a row has the same number whenever it is read.
    rows = written(staged.withColumn("_row", F.monotonically_increasing_id()), "list-rows")
    hashed = _hashed(terms)
    lengths = [r[0] for r in hashed.select("n").distinct().collect()]
    found = _joined(_likely_runs(rows, lengths, bit_map(hashed)), hashed)
    cut = _cut_at_found()("_segments", "_found")
    return rows.join(found, "_row", "left").select(*columns, cut.alias("_segments"))
