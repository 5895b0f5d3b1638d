"""Benchmark decontamination: exact containment of item windows, by prefix filtering.

Words are maximal runs of ASCII letters and digits and of characters above
ASCII, with A-Z lowered. A window is ``size`` consecutive words of an item; an
item of fewer words, but not none, is one window. A document is contaminated if
a window occurs in it.

1. Rarity. The words of the items are counted in all documents.
2. Prefix. A window has to be contained whole, so one word of it is a necessary
   prefix, and the rarest is taken (of equal ones the first). Documents' words
   are joined with these prefix words only.
3. Bounds. A match fixes where the window would begin: it has to begin and end
   inside the document (position and length).
4. Verification. All words of the window are compared at that place.

The windows of items of at most ITEM_BYTES of text, measured before, travel to
the tasks. Those of more are joined with the documents' words on Spark, and no
item is on the driver: it gets a map of the items' words and a sketch of their
counts, both of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.bit_map import bit_map, may_hold
from spanveil.llm.tables import filtered, saved, slices
from spanveil.llm.words import Splitter, letters_digits, lower_az

WINDOW = 10
ITEM_BYTES = 8 << 20
# Counters of the sketch of word counts.
SKETCH = 1 << 20


def _splitter() -> Splitter:
    return Splitter(letters_digits(), lower_az())


@dataclass
class Windows:
    """Windows of a few items, sorted by the hash of their prefix word."""

    words: np.ndarray  # hashes of all items' words, one item after the other
    starts: np.ndarray  # first word of each distinct window
    sizes: np.ndarray
    prefix: np.ndarray  # hash of the rarest word
    offset: np.ndarray  # its place in the window
    owners: list[list[str]]  # ids of the items that have the window

    @staticmethod
    def of(items: list[tuple[str, str]], rarity: dict[int, int], size: int) -> Windows:
        split = _splitter().split(pa.array([text for _, text in items], pa.large_string()))
        seen: dict[bytes, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        owners: list[list[str]] = []
        counts = np.array([rarity.get(int(h), 0) for h in split.hashes], dtype=np.int64)
        for i, (item, _) in enumerate(items):
            low, high = int(split.bounds[i]), int(split.bounds[i + 1])
            width = min(size, high - low)
            for start in range(low, high - width + 1) if width else ():
                key = split.hashes[start : start + width].tobytes()
                at = seen.setdefault(key, len(rows))
                if at == len(rows):
                    offset = int(np.argmin(counts[start : start + width]))
                    rows.append((start, width, int(split.hashes[start + offset]), offset))
                    owners.append([])
                if not owners[at] or owners[at][-1] != item:
                    owners[at].append(item)
        order = sorted(range(len(rows)), key=lambda j: rows[j][2])
        column = lambda k, kind: np.array([rows[j][k] for j in order], dtype=kind)
        return Windows(
            split.hashes, column(0, np.int64), column(1, np.int64), column(2, np.uint64), column(3, np.int64),
            [owners[j] for j in order],
        )

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence in documents whose words are hashes[bounds[r]:bounds[r+1]]."""
        low = np.searchsorted(self.prefix, hashes, "left")
        most = len(self.prefix)
        at = np.flatnonzero(self.prefix[np.minimum(low, most - 1)] == hashes) if most else np.zeros(0, np.int64)
        low = low[at]
        many = np.searchsorted(self.prefix, hashes[at], "right") - low
        place = np.repeat(at, many)
        first = np.cumsum(many) - many
        window = np.arange(len(place)) - np.repeat(first - low, many)
        row = np.searchsorted(bounds, place, "right") - 1
        begin = place - self.offset[window]
        inside = (begin >= bounds[row]) & (begin + self.sizes[window] <= bounds[row + 1])
        window, begin = window[inside], begin[inside]
        for step in range(int(self.sizes.max()) if most else 0):
            if not len(window):
                break
            there = step < self.sizes[window]
            mine = self.words[np.where(there, self.starts[window] + step, 0)]
            same = ~there | (mine == hashes[np.where(there, begin + step, 0)])
            window, begin = window[same], begin[same]
        return window, begin


def _rarity(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the items (by hash) occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        for piece in slices(batches, 0):
            hashes = splitter.split(piece.column(0)).hashes
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            counts += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select(F.col("_text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(vocabulary[r.word]): r.n for r in rows.collect()}


def _texts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )


def _few(texts: DataFrame) -> list[tuple[str, str]] | None:
    """The items, if they are few; else None."""
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size > ITEM_BYTES:
        return None
    return [(r._item, r._text) for r in texts.orderBy("_item", "_text").collect()]


def _item_windows(texts: DataFrame, size: int) -> DataFrame:
    """``item, window``: the hashes of each window's words, once per item; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        for piece in slices(batches, 1):
            split = splitter.split(piece.column(1))
            for i, item in enumerate(piece.column(0).to_pylist()):
                hashes = split.hashes[split.bounds[i] : split.bounds[i + 1]]
                width = min(size, len(hashes))
                starts = range(len(hashes) - width + 1) if width else ()
                windows = sorted({hashes[k : k + width].tobytes() for k in starts})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(windows), pa.string()), pa.array(windows, pa.binary())], names=["item", "window"])

    return saved(texts.mapInArrow(run, "item string, window binary").distinct(), "item-windows")


def _words_of(windows: DataFrame) -> DataFrame:
    """``hash`` of the words of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words)], names=["hash"])

    return windows.select("window").mapInArrow(run, "hash long")


def _counts(rows: DataFrame, bits: np.ndarray) -> np.ndarray:
    """A sketch of how often the words that the map knows occur in all documents: counts by hash, modulo its size."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = _splitter(), shared.value
        counts = np.zeros(SKETCH, dtype=np.int64)
        for piece in slices(batches, 0):
            hashes = splitter.split(piece.column(0)).hashes
            counts += np.bincount((hashes[may_hold(known, hashes)] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    found = rows.select("_text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, dtype=np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(windows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``prefix`` (the rarest word), ``offset``, ``size``, ``window`` of distinct windows; written."""
    shared = windows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            columns: list[list] = [[], [], []]
            for window in batch.column(0).to_pylist():
                words = np.frombuffer(window, dtype=np.uint64)
                offset = int(np.argmin(rarity[(words % np.uint64(SKETCH)).astype(np.int64)]))
                for column, value in zip(columns, (int(words[offset].view(np.int64)), offset, len(words))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), batch.column(0)], names=["prefix", "offset", "size", "window"]
            )

    found = windows.select("window").distinct().mapInArrow(run, "prefix long, offset long, size long, window binary")
    return saved(found, "item-prefixes")


def _places(rows: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """A row per document (``row, id, n_words``), and one per word that may be a prefix; written.

    Such a word has its place ``at`` and ``around``: the hashes of ``size`` - 1
    words before and behind it, zeros beyond the text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    reach = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = _splitter(), shared.value
        for piece in slices(batches, 2):
            split = splitter.split(piece.column(2))
            counts = np.diff(split.bounds)
            place = np.flatnonzero(may_hold(known, split.hashes))
            row = np.searchsorted(split.bounds, place, "right") - 1
            near = place[:, None] + np.arange(-reach, reach + 1)
            inside = (near >= split.bounds[row][:, None]) & (near < split.bounds[row + 1][:, None])
            around = np.where(inside, split.hashes[np.clip(near, 0, max(len(split.hashes) - 1, 0))], np.uint64(0)) if len(place) else near
            numbers, n, m = piece.column(0), piece.num_rows, len(place)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([numbers, numbers.take(pa.array(row))]),
                    pa.concat_arrays([piece.column(1), pa.nulls(m, piece.column(1).type)]),
                    pa.concat_arrays([pa.array(counts, pa.int64()), pa.array(counts[row], pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(split.hashes[place].view(np.int64))]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(place - split.bounds[row], pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([a.tobytes() for a in around], pa.binary())]),
                ],
                names=["row", "_id", "n_words", "prefix", "at", "around"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("row", "_id", "_text").mapInArrow(run, f"row long, _id {kind}, n_words long, prefix long, at long, around binary")
    return saved(found, "document-places")


def _joined(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``row, _id, n_words, hits, items`` of documents (``row, _id, _text``), all by joins on Spark."""
    owners = _item_windows(texts, size)
    windows = _prefixes(owners, _counts(rows, bit_map(_words_of(owners))))
    places = _places(rows, bit_map(windows.select(F.col("prefix").alias("hash"))), size)
    met = places.where("prefix IS NOT NULL").join(windows, "prefix")
    # Length and position: the window has to lie in the document; then all its words are compared.
    first = F.col("at") - F.col("offset")
    same = F.expr(f"substring(around, cast(8 * ({size - 1} - offset) + 1 AS int), cast(8 * size AS int)) = window")
    hits = met.where((first >= 0) & (first + F.col("size") <= F.col("n_words")) & same)
    hits = saved(hits.select("row", first.alias("first"), "size", "window"), "leaks")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("first", "size")).alias("hits"))
    items = hits.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.collect_set("item").alias("items"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    whole = places.where("prefix IS NULL").select("row", "_id", "n_words").join(spans, "row", "left").join(items, "row", "left")
    return whole.select("row", "_id", "n_words", none("hits", "array<struct<first: long, size: long>>"), none("items", "array<string>"))


def _searcher(docs: DataFrame, part: list[tuple[str, str]], size: int):
    """A broadcast of the windows, by the rarity of its words in ``docs`` (column ``_text``)."""
    vocabulary = np.unique(_splitter().split(pa.array([t for _, t in part], pa.large_string())).hashes)
    windows = Windows.of(part, _rarity(docs, vocabulary), size)
    # Plain arrays: what is broadcast is pickled by reference, and workers need not have this package.
    return docs.sparkSession.sparkContext.broadcast(tuple(getattr(windows, f.name) for f in fields(Windows)))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW,
) -> DataFrame:
    """Id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as strings), ``contaminated``.

    ``n_hit`` counts words inside any occurrence. Nulls, empty texts and texts
    without words have none and are clean; items without words match nothing; an
    item with a null id is named by the empty string. Rows keep their number.
    """
    texts = _texts(items, item_id, item_text)
    few = _few(texts)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = _joined(rows.withColumn("row", F.monotonically_increasing_id()), texts, size) if few is None else _searched(rows, few, size)
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["first"] + h["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), h["first"] + h["size"] - F.greatest(acc["end"], h["first"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        F.col("_id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"), (F.size("hits") > 0).alias("contaminated"),
    )


def _searched(rows: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    """``_id, n_words, hits, items`` of documents (``_id, _text``), by the windows of a few items."""
    shared = _searcher(rows, items, size)
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, windows = _splitter(), Windows(*shared.value)
        for piece in slices(batches, 1):
            split = splitter.split(piece.column(1))
            window, begin = windows.found(split.hashes, split.bounds)
            order = np.argsort(begin, kind="stable")
            window, begin = window[order], begin[order]
            cuts = np.searchsorted(begin, split.bounds)
            n = piece.num_rows
            hits, owners = [[] for _ in range(n)], [[] for _ in range(n)]
            for r in np.flatnonzero(np.diff(cuts)):
                mine = slice(cuts[r], cuts[r + 1])
                sizes = windows.sizes[window[mine]]
                hits[r] = [{"first": int(b - split.bounds[r]), "size": int(s)} for b, s in zip(begin[mine], sizes)]
                owners[r] = sorted({x for w in np.unique(window[mine]) for x in windows.owners[w]})
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0), pa.array(np.diff(split.bounds), pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))),
                    pa.array(owners, pa.list_(pa.string())),
                ],
                names=["_id", "n_words", "hits", "items"],
            )

    return rows.mapInArrow(run, f"_id {id_type}, n_words long, hits array<struct<first: long, size: long>>, items array<string>")


def keep_clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item window. For few items no text is exchanged."""
    texts = _texts(items, item_id, item_text)
    few = _few(texts)
    if few is None:
        numbered = saved(docs.withColumn("_leak_row", F.monotonically_increasing_id()), "leak-rows")
        row = F.col("_leak_row")
        rows = numbered.select(row.alias("row"), row.alias("_id"), F.col(text_col).cast("string").alias("_text"))
        leaking = saved(_joined(rows, texts, size).where(F.size("hits") > 0).select(F.col("row").alias("_leak_row")), "leaking-rows")
        return numbered.join(leaking, "_leak_row", "left_anti").select(*docs.columns)
    shared = _searcher(docs.select(F.col(text_col).cast("string").alias("_text")), few, size)

    def make():
        splitter, windows = _splitter(), Windows(*shared.value)

        def clean(texts: pa.Array) -> np.ndarray:
            split = splitter.split(texts)
            _, begin = windows.found(split.hashes, split.bounds)
            out = np.ones(len(texts), dtype=bool)
            out[np.searchsorted(split.bounds, begin, "right") - 1] = False
            return out

        return clean

    return filtered(docs, text_col, make)
