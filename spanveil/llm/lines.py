"""Line dedup by winnowing over line hashes.

A line is a maximal run of characters other than newline. A run of RUN lines
that stood before, in a document of smaller id or further up in the same one, is
deleted; longer repeated runs go whole, since each of their parts does.

1. Winnowing. Of every RUN consecutive line hashes the least (the last of equal
   ones) is a fingerprint, so every run of RUN lines holds one, and equal runs
   hold it at the same place.
2. Join. Fingerprints that occur more than once are joined with their positions.
3. Extension. From each such position the match is extended both ways over all
   runs of RUN lines that hold it; equal runs meet, and the first place of each
   is found by partial minima, so no group is gathered, however common a line is.
4. Deletion. All later runs go.

With ``words``, shorter runs, down to one line, go as well where they hold so many
words; each length is matched in the same way.

Only hashes and positions cross the network until the deletion; texts do once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.tables import saved, slices
from spanveil.llm.words import Runs, Splitter, covered, not_newline, not_space, window_minima

RUN = 3


def _fingerprints(rows: DataFrame, run: int, words: int = 0) -> DataFrame:
    """``mark`` (fingerprint), ``id``, and ``around``: hash and first line of each run that holds it.

    Runs of less than ``words`` words are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, runs = Splitter(not_newline()), Runs()
        counter = Splitter(not_space()) if words else None
        for piece in slices(batches, 1):
            lines = splitter.split(piece.column(1))
            if counter:
                begins = counter.split(piece.column(1)).begins
                sizes = np.searchsorted(begins, lines.ends) - np.searchsorted(begins, lines.begins)
            marks, ids, around = [], [], []
            for i, doc in enumerate(piece.column(0).to_pylist()):
                hashes = lines.hashes[lines.bounds[i] : lines.bounds[i + 1]]
                if len(hashes) < run:
                    continue
                grams = runs.grams(hashes, run).view(np.int64)
                wide = np.ones(len(grams), dtype=bool)
                if counter:
                    sums = np.concatenate([[0], np.cumsum(sizes[lines.bounds[i] : lines.bounds[i + 1]])])
                    wide = sums[run:] - sums[:-run] >= words
                for place in window_minima(hashes, run):
                    low, high = max(0, place - run + 1), min(place, len(grams) - 1)
                    held = [{"run": int(grams[j]), "first": j} for j in range(low, high + 1) if wide[j]]
                    if held:
                        marks.append(hashes[place])
                        ids.append(doc)
                        around.append(held)
            kind = pa.list_(pa.struct([("run", pa.int64()), ("first", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(around, kind)],
                names=["mark", "id", "around"],
            )

    return rows.mapInArrow(work, "mark long, id long, around array<struct<run: long, first: int>>")


def later_runs(docs: DataFrame, id_col: str, text_col: str, run: int, words: int = 0) -> DataFrame:
    """``id``, ``starts``: first lines of the runs of ``run`` lines, of ``words`` words or more, that stood before."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marks = _fingerprints(rows, run, words)
    # Aggregates are written before they are joined: a join right on top of one
    # shares its partitions, and Spark could not split a very common line.
    common = saved(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "line-marks")
    places = marks.join(common, "mark").select("id", F.explode("around").alias("at")).select("id", "at.run", "at.first")
    places = saved(places.distinct(), "line-runs")
    first = saved(
        places.groupBy("run").agg(F.min(F.struct("id", "first")).alias("before"), F.count("*").alias("n"))
        .where("n > 1").select("run", "before"),
        "first-runs",
    )
    later = places.join(first, "run").where(F.struct("id", "first") > F.col("before"))
    return later.groupBy("id").agg(F.sort_array(F.collect_set("first")).alias("starts"))


def _later_lines(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """``id``, ``starts``: the lines of runs that stood before and have ``run`` lines, or fewer that hold ``words`` words."""
    each = None
    for k in range(1, run + 1):
        found = later_runs(docs, id_col, text_col, k, 0 if k == run else words)
        lines = found.select("id", F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (k - 1)))).alias("lines"))  # noqa: B023
        each = lines if each is None else each.union(lines)
    return each.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("starts"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = None
) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` less its later repeated runs, plus ``n_lines``, ``n_removed``.

    A text that loses lines is made of its kept lines, joined by newlines; all
    others stay as they are, nulls included. Texts of fewer lines lose none. Rows
    without an id neither lose lines nor make others lose any. Rows of one id are
    one document, and what any of them repeats goes from each. With ``words``, later
    runs of fewer lines go too if they hold that many words. Columns of ``docs``
    may not be named ``n_lines`` or ``n_removed``; such are replaced.
    """

    later = later_runs(docs, id_col, text_col, run) if words is None else _later_lines(docs, id_col, text_col, run, words)
    long = run if words is None else 1
    starts = later.select(F.col("id").alias("_dedup_id"), F.col("starts").alias("_dedup_starts"))
    known = docs.where(F.col(id_col).isNotNull()).join(starts, F.col(id_col).cast("long") == F.col("_dedup_id"), "left").drop("_dedup_id")
    unknown = docs.where(F.col(id_col).isNull()).withColumn("_dedup_starts", F.lit(None).cast("array<int>"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    done = known.union(unknown).select(*kept, "_dedup_starts").withColumn(text_col, F.col(text_col).cast("string"))
    fields = [T.StructField(text_col, T.StringType()) if f.name == text_col else f for f in docs.schema if f.name in kept]
    counts = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")]
    place, width = kept.index(text_col), len(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(not_newline())
        for piece in slices(batches, place, fill=False):
            lines = splitter.split(piece.column(place).fill_null(""))
            removed, texts = np.zeros(piece.num_rows, dtype=np.int64), {}
            for i, at in enumerate(piece.column(width).to_pylist()):
                if at is None:
                    continue
                low, high = lines.bounds[i], lines.bounds[i + 1]
                first = np.asarray(at, dtype=np.int64)
                gone = covered(high - low, first, first + long)
                removed[i] = gone.sum()
                if removed[i]:
                    begins, ends = lines.begins[low:high][~gone], lines.ends[low:high][~gone]
                    texts[i] = b"\n".join(lines.data[b:e].tobytes() for b, e in zip(begins, ends)).decode()
            columns = list(piece.columns[:width])
            # Texts that lose nothing stay as they came, nulls included.
            given = columns[place].cast(pa.string())
            columns[place] = pa.array([texts.get(i, x) for i, x in enumerate(given.to_pylist())], pa.string()) if texts else given
            columns += [pa.array(np.diff(lines.bounds), pa.int64()), pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_lines", "n_removed"])

    return done.mapInArrow(cut, T.StructType([*fields, *counts]))
