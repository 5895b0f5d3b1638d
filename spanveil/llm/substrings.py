"""Substring dedup by prefix-partitioned suffix trees.

A window of WINDOW words goes wherever its word sequence also starts in a
document of smaller id. In the suffix tree of all texts, that is a node at depth
WINDOW with leaves in several documents. The tree is never held whole: it is cut
at prefixes, and only nodes that can lead to such depth are opened.

1. Suffixes. Of every WINDOW words, one of the first WINDOW - PREFIX + 1 suffixes
   is entered: the one whose PREFIX-word beginning has the least hash. Equal
   windows enter it at the same offset, so no repeat is missed, and one suffix in
   about 13 is entered.
2. Nodes at depth PREFIX. Suffixes are grouped by their first PREFIX words.
   Groups of one document lead to no repeat and are left.
3. Longer paths split the others. The full path of a suffix runs as far as the
   windows around it reach, left and right. Where all suffixes of a node have one
   path, the node does not branch: all windows on it are repeats. Where it
   branches, suffixes on the path of a smaller document are repeats too, and only
   the first suffix of each path is opened further.
4. Deep nodes. The windows on opened paths are grouped by all of their WINDOW
   words; those of a later document are repeats.

Groups hold minima only, made by partial aggregation, so a passage that a third
of all documents share is no large group. Adjoining repeats of one document form
its maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import saved, slices
from spanveil.llm.words import Runs, Splitter, covered, mix, not_space, window_minima

WINDOW = 50


def _prefix(window: int) -> int:
    return (window + 1) // 2


def _suffixes(rows: DataFrame, window: int) -> DataFrame:
    """``node`` (hash of the prefix), ``path`` (hash of the full path), ``id``, ``at`` of the entered suffixes."""
    prefix = _prefix(window)
    reach = window - prefix

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, runs = Splitter(not_space()), Runs()
        for piece in slices(batches, 1):
            words = splitter.split(piece.column(1))
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for i, doc in enumerate(piece.column(0).to_pylist()):
                hashes = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                n = len(hashes)
                if n < window:
                    continue
                sums = runs.sums(hashes)
                begin = np.arange(n - prefix + 1)
                nodes = runs.between(sums, begin, begin + prefix)
                at = window_minima(nodes, reach + 1)
                left, right = np.minimum(at, reach), np.minimum(n - at - prefix, reach)
                path = mix(runs.between(sums, at - left, at + prefix + right) + left.astype(np.uint64))
                for column, values in zip(columns, (nodes[at], path, np.full(len(at), doc), at)):
                    column.append(values)
            node, path, ids, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(path.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(at.astype(np.int32))],
                names=["node", "path", "id", "at"],
            )

    return rows.mapInArrow(work, "node long, path long, id long, at int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``deep`` (hash of a window), ``id``, ``first`` of all windows around the opened suffixes."""
    reach = window - _prefix(window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, runs = Splitter(not_space()), Runs()
        for piece in slices(batches, 1):
            words = splitter.split(piece.column(1))
            columns: list[list[np.ndarray]] = [[], [], []]
            for i, (doc, opened) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                hashes = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                n, at = len(hashes), np.asarray(opened, dtype=np.int64)
                if n < window:
                    continue
                first = np.flatnonzero(covered(n - window + 1, at - reach, at + 1))
                for column, values in zip(columns, (runs.between(runs.sums(hashes), first, first + window), np.full(len(first), doc), first)):
                    column.append(values)
            deep, ids, first = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(deep.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(first.astype(np.int32))], names=["deep", "id", "first"]
            )

    return texts.mapInArrow(work, "deep long, id long, first int")


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = docs.where(F.col(id_col).isNotNull())
    return ids.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def repeated_places(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``id``, ``suffixes`` (all windows around these are repeats), ``windows`` (first words of further repeats)."""
    rows = _known(docs, id_col, text_col)
    suffixes = _suffixes(rows, window)
    # Minima are written before they are joined: a join right on top of an
    # aggregate shares its partitions, and Spark could not split a large key.
    nodes = saved(
        suffixes.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("path").alias("p"), F.max("path").alias("q"))
        .where("least < most").select("node", "least", (F.col("p") == F.col("q")).alias("straight")),
        "nodes",
    )
    inner = saved(suffixes.join(nodes, "node"), "suffixes")
    branching = inner.where("NOT straight").select("node", "path", "id", "at")
    paths = saved(branching.groupBy("node", "path").agg(F.min("id").alias("least")), "paths")
    walked = branching.join(paths, ["node", "path"])
    repeats = inner.where("straight AND id > least").select("id", "at").union(walked.where("id > least").select("id", "at"))
    opened = walked.where("id = least").groupBy("id").agg(F.collect_set("at").alias("opened"))
    texts = rows.join(opened, rows["_id"] == opened["id"]).select("_id", "_text", "opened")
    deep = saved(_windows(texts, window), "windows")
    first = saved(
        deep.groupBy("deep").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("deep", "least"),
        "first-windows",
    )
    later = deep.join(first, "deep").where("id > least").select("id", "first")
    both = repeats.select("id", F.col("at").alias("suffix"), F.lit(None).cast("int").alias("window")).union(
        later.select("id", F.lit(None).cast("int"), "first")
    )
    return both.groupBy("id").agg(F.collect_set("suffix").alias("suffixes"), F.collect_set("window").alias("windows"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Id, ``n_words``, ``n_removed``, ``kept`` (kept words joined by a blank), ``spans`` of removed words.

    A span is (first word, word after the last) of a maximal repeat. Nulls and
    empty texts have no words; texts of less than a window lose none. Rows
    without an id neither lose words nor make others lose any. Rows of one id are
    one document, and what any of them repeats goes from each, as far as its text
    reaches. Rows keep their number.
    """
    reach = window - _prefix(window)

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<struct<first: int, end: int>>")
    def cut(texts: pd.Series, suffixes: pd.Series, windows: pd.Series) -> pd.DataFrame:
        splitter = Splitter(not_space())
        rows = []
        for text, around, firsts in zip(texts, suffixes, windows):
            words = splitter.split(pa.array([text or ""], pa.large_string()))
            n = len(words.hashes)
            gone = np.zeros(n, dtype=bool)
            if around is not None and n >= window:
                starts = covered(n - window + 1, np.asarray(around, np.int64) - reach, np.asarray(around, np.int64) + 1)
                starts[[x for x in firsts if x < len(starts)]] = True
                first = np.flatnonzero(starts)
                gone = covered(n, first, first + window)
            raw = words.data.tobytes()
            kept = b" ".join(raw[b:e] for b, e, g in zip(words.begins, words.ends, gone) if not g).decode()
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
            rows.append((n, int(gone.sum()), kept, [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "spans"])

    found = repeated_places(docs, id_col, text_col, window)
    known = _known(docs, id_col, text_col)
    joined = known.join(found, known["_id"] == found["id"], "left").select("_id", "_text", "suffixes", "windows")
    none = F.lit(None).cast("array<int>")
    unknown = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.col(text_col).cast("string"), none, none)
    return joined.union(unknown).select(F.col("_id").alias(id_col), cut("_text", "suffixes", "windows").alias("cut")).select(id_col, "cut.*")
