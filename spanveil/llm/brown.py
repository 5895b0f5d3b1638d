"""Language model scores by Brown's class-based n-grams.

Tokens are words (A-Z lowered) and one end per text. The model predicts each
token from the class of the one before:

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

The UNITS commonest words and GROUPS groups of all other words by their shape
(last two bytes, length, letters above ASCII) are assigned to CLASSES classes by
exchange clustering: each in turn moves to the class that raises the mutual
information of adjoining classes most, until none moves. Then each other word of
the training texts leaves its group for the class that raises it most, by all
places that the word stands at; the words beside it have the classes of the
exchange there. A word that was never seen has the class of its group. Transitions
are counted when all words have their class.

With ``units`` given, so many words alone have classes of their own; all others
stay with their group, and P(w | class(w)) = P(unit(w) | class(w)) * P(w | unit(w)).

Smoothing: transitions are mixed with the classes' own frequencies, words and
unknown words of a group get half a count, and within a group of known words each
has one count more than seen and one is left for all unknown words.

What is gathered: the counts of all words, of all adjoining units and of the
classes beside each word, in all training texts. Words with counts and classes
stay a table. Of it, the words above a count that at most HOT words reach go along
with the tasks, as do the tables of units and classes, whose size does not depend
on the texts. Rarer words are joined by a shuffle, and as they are rare no key of
it is large. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import saved, slices
from spanveil.llm.words import Splitter, Words, lower_az, mix, not_space

UNITS, GROUPS, CLASSES = 600, 256, 64
HOT = 200_000
# Words that a task counts before it hands on what it has.
CHUNK = 4 << 20
# Weight of the classes' own frequencies in a transition.
MIXED = 20.0
# The end of a text, as the hash of a word.
END = np.uint64(0x5851F42D4C957F2D)


def _splitter() -> Splitter:
    return Splitter(not_space(), lower_az())


def shapes(words: Words) -> np.ndarray:
    """The group of each word, by its shape."""
    if not len(words.hashes):
        return np.zeros(0, dtype=np.int64)
    last = words.data[words.ends - 1].astype(np.uint64)
    size = words.ends - words.begins
    before = np.where(size > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    # Separators are ASCII, so the greatest byte up to the next word tells.
    foreign = (np.maximum.reduceat(words.data, words.begins) >= 0x80).astype(np.uint64)
    length = np.searchsorted([3, 5, 8, 12], size).astype(np.uint64)
    shape = ((last * np.uint64(256) + before) * np.uint64(2) + foreign) * np.uint64(5) + length
    return (mix(shape + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64)


def with_ends(values: np.ndarray, bounds: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The items of each text followed by its end, and the new bounds."""
    texts = len(bounds) - 1
    out = np.empty(len(values) + texts, dtype=values.dtype)
    ends = bounds[1:] + np.arange(texts)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner], out[ends] = values, end
    return out, bounds + np.arange(texts + 1)


def _counts(rows: DataFrame) -> DataFrame:
    """``word``, ``shape``, ``c`` (in training texts), ``every`` (in all), of all words but the end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        held: list[tuple[np.ndarray, ...]] = []
        room = CHUNK

        def merged() -> pa.RecordBatch:
            hashes, shape, c, every = (np.concatenate(x) for x in zip(*held))
            found, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            columns = [found.view(np.int64), shape[first], np.bincount(of, c).astype(np.int64), np.bincount(of, every).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "shape", "c", "every"])

        for piece in slices(batches, 2):
            words = splitter.split(piece.column(2))
            if not len(words.hashes):
                continue
            trained = np.repeat(piece.column(1).to_numpy(zero_copy_only=False), np.diff(words.bounds))
            found, first, of = np.unique(words.hashes, return_index=True, return_inverse=True)
            held.append((found, shapes(words)[first], np.bincount(of, trained), np.bincount(of).astype(np.float64)))
            room -= len(found)
            if room <= 0:
                yield merged()
                held, room = [], CHUNK
        if held:
            yield merged()

    parts = rows.mapInArrow(work, "word long, shape long, c long, every long")
    return parts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"), F.sum("every").alias("every"))


@dataclass
class Units:
    """The units' words, sorted by hash; unit 0 is the end, groups come after the words."""

    words: np.ndarray

    @property
    def size(self) -> int:
        return 1 + len(self.words) + GROUPS

    def of(self, words: Words) -> np.ndarray:
        return self.at(words.hashes, shapes(words))

    def at(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        group = 1 + len(self.words) + shape
        if not len(self.words):
            return group
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, 1 + at, group)


def _transitions(rows: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each other in training texts; the first follows an end."""
    size = units.size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        total = np.zeros(size * size, dtype=np.int64)
        for piece in slices(batches, 0):
            words = splitter.split(piece.column(0))
            after, _ = with_ends(units.of(words), words.bounds, 0)
            before = np.concatenate([[0], after[:-1]])
            pairs, n = np.unique(before * size + after, return_counts=True)
            total[pairs] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    trained = rows.where("_trained").select("_text")
    found = trained.mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """The class of each unit, by exchange clustering of a unit transition matrix.

    Raises sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., d)) with f(x) = x log x,
    which is the mutual information of adjoining classes but for a constant.
    Sweeps, unless so many are asked for, go on until no unit moves. Each move raises the sum, so no state comes
    twice, and one that does, by rounding, ends them. Units without a count stay
    where they start.
    """
    units = len(pairs)
    order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
    of = np.empty(units, dtype=np.int64)
    of[order] = np.arange(units) % classes
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    right, left = pairs @ member, pairs.T @ member  # unit to class, class to unit
    every = np.arange(classes)
    seen: set[bytes] = set()
    while of.tobytes() not in seen and len(seen) != sweeps:
        seen.add(of.tobytes())
        for u in order:
            own, row, column = pairs[u, u], right[u].copy(), left[u].copy()
            if not row.any() and not column.any():
                continue
            c = of[u]
            # Take the unit out of its class.
            row[c] -= own
            column[c] -= own
            table[c] -= row
            table[:, c] -= column
            table[c, c] -= own
            # What leaves and enters the other members of each class, the unit's own neighbours among them.
            out_row, out_column = table.sum(axis=1) + column, table.sum(axis=0) + row
            total_row, total_column = row.sum() + own, column.sum() + own
            gain = (_f(table + row) - _f(table)).sum(axis=1) + (_f(table.T + column) - _f(table.T)).sum(axis=1)
            diagonal = table[every, every]
            gain += _f(diagonal + row + column + own) + _f(diagonal) - _f(diagonal + row) - _f(diagonal + column)
            # The marginals of the classes that the unit meets do not depend on its class.
            gain -= _f(out_row + total_row) - _f(out_row) + _f(out_column + total_column) - _f(out_column)
            best = int(gain.argmax()) if gain.max() > gain[c] + 1e-9 * abs(gain[c]) else int(c)
            table[best] += row
            table[:, best] += column
            table[best, best] += own
            if best != c:
                of[u] = best
                right[:, c] -= pairs[:, u]
                right[:, best] += pairs[:, u]
                left[:, c] -= pairs[u]
                left[:, best] += pairs[u]
    return of


# What a word's places tell: a class after it, or CLASSES more a class before it, and how often.
_BESIDE = np.dtype([("at", "<u2"), ("n", "<u4")])
# Small counts, whose gains are looked up, and counts of places that are worked on at a time.
SMALL, BLOCK = 16, 1 << 15


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The items of ``data`` in rows of so many, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _items(rows: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What `_binary` was made of."""
    kind = np.dtype(kind)
    rows = rows.cast(pa.large_binary()).fill_null(b"")
    if not len(rows):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets) // kind.itemsize


def _beside(rows: DataFrame, units: Units, of: np.ndarray, classes: int) -> DataFrame:
    """``word``, ``own`` (class of its group), ``beside`` (_BESIDE), of the words of training texts that are no units; parts of a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        first_group = 1 + len(units.words)
        held: list[tuple[np.ndarray, ...]] = []
        room = CHUNK // 2

        def merged() -> Iterator[pa.RecordBatch]:
            hashes, own, after, before = (np.concatenate(x) for x in zip(*held))
            found, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            codes = np.concatenate([number * (2 * classes) + after, number * (2 * classes) + classes + before])
            codes, n = np.unique(codes, return_counts=True)
            items = np.empty(len(codes), dtype=_BESIDE)
            items["at"], items["n"] = codes % (2 * classes), n
            columns = [pa.array(found.view(np.int64)), pa.array(own[first]), _binary(items, np.bincount(codes // (2 * classes), minlength=len(found)))]
            yield from pa.Table.from_arrays(columns, names=["word", "own", "beside"]).to_batches(1 << 16)

        for piece in slices(batches, 0):
            words = splitter.split(piece.column(0))
            unit, bounds = with_ends(units.of(words), words.bounds, 0)
            of_token = of[unit]
            ends = np.zeros(len(unit), dtype=bool)
            ends[bounds[1:] - 1] = True
            other = np.flatnonzero(unit >= first_group)
            if not len(other):
                continue
            before = np.concatenate([[of[0]], of_token[:-1]])
            held.append((words.hashes[unit[~ends] >= first_group], of_token[other], of_token[other + 1], before[other]))
            room -= len(other)
            if room <= 0:
                yield from merged()
                held, room = [], CHUNK // 2
        if held:
            yield from merged()

    return rows.where("_trained").select("_text").mapInArrow(work, "word long, own long, beside binary")


def best_classes(table: np.ndarray, own: np.ndarray, number: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that raises the mutual information of ``table`` most, when it leaves its ``own`` class.

    ``number`` (ascending), ``at``, ``n``: the word, the class after it (or, by as
    many as there are classes more, before it) and how often. The table holds the
    word's places under ``own``. All words are judged by the same table.
    """
    classes, words = len(table), len(own)
    met = np.concatenate([table.T, table])  # class beside to class
    small = np.stack([_f(met + k) - _f(met) for k in range(SMALL + 1)])
    gain = np.zeros((words, classes))
    low = 0
    while low < len(number):
        high = int(np.searchsorted(number, number[min(low + BLOCK, len(number)) - 1], "right"))
        here, k = at[low:high], n[low:high]
        rise = small[np.minimum(k, SMALL).astype(np.int64), here]
        large = np.flatnonzero(k > SMALL)
        rise[large] = _f(met[here[large]] + k[large, None]) - _f(met[here[large]])
        begins = np.flatnonzero(np.concatenate([[True], number[low + 1 : high] != number[low : high - 1]]))
        gain[number[low:high][begins]] = np.add.reduceat(rise, begins)
        low = high
    full = met[at, own[number]]
    stay = np.bincount(number, _f(full) - _f(np.maximum(full - n, 0)), words)
    seen = np.bincount(number * (2 * classes) + at, n, words * 2 * classes).reshape(words, 2, classes)
    row, column = seen[:, 0], seen[:, 1]
    # A class beside itself counts once.
    w, c = np.nonzero((row > 0) & (column > 0))
    diagonal, r, l = np.diagonal(table)[c], row[w, c], column[w, c]
    gain[w, c] += _f(diagonal + r + l) + _f(diagonal) - _f(diagonal + r) - _f(diagonal + l)
    # The word's own places are not in what its class has of another.
    every = np.arange(words)
    for to, here, back in ((table.T, row, column), (table, column, row)):
        w = np.flatnonzero(here[every, own])
        full, k = to[own[w]], here[w, own[w]][:, None]
        less = np.maximum(full - back[w], 0)
        gain[w] += _f(less + k) - _f(less) - _f(full + k) + _f(full)
    diagonal, r, l = np.diagonal(table)[own], row[every, own], column[every, own]
    less = lambda x: _f(np.maximum(diagonal - x, 0))
    stay += less(r) + less(l) - less(0 * r) - less(r + l)
    for marginal, total in ((table.sum(axis=1), row.sum(axis=1)), (table.sum(axis=0), column.sum(axis=1))):
        gain -= _f(marginal + total[:, None]) - _f(marginal)
        stay -= _f(marginal[own]) - _f(np.maximum(marginal[own] - total, 0))
    gain[every, own] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[every, best] > stay + 1e-9 * np.abs(stay), best, own)


def _assigned(parts: DataFrame, table: np.ndarray) -> DataFrame:
    """``word``, ``found``: the class of each word, by all its parts."""
    classes = len(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(word, own, sizes, items) -> pa.RecordBatch:
            new = np.concatenate([[True], word[1:] != word[:-1]])
            of = np.repeat(np.cumsum(new) - 1, sizes)
            codes, back = np.unique(of * (2 * classes) + items["at"], return_inverse=True)
            n = np.bincount(back, items["n"])
            best = best_classes(table, own[new], codes // (2 * classes), codes % (2 * classes), n)
            return pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(best)], names=["word", "found"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            items, sizes = _items(batch.column(2), _BESIDE)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes, items))
            word, own, sizes, items = (np.concatenate(x) for x in zip(*held))
            # Parts of the last word may follow.
            first = int(np.searchsorted(word, word[-1])) if len(word) else 0
            cut = int(sizes[:first].sum())
            if first:
                yield done(word[:first], own[:first], sizes[:first], items[:cut])
            held = [(word[first:], own[first:], sizes[first:], items[cut:])]
        if held and len(held[0][0]):
            yield done(*held[0])

    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(work, "word long, found long")


@dataclass
class Model:
    units: Units
    of: np.ndarray  # class of each unit
    step: np.ndarray  # log10 P(class | class before)
    unit: np.ndarray  # log10 P(unit | its class), and for groups less log10 of the group's total
    hot: np.ndarray  # sorted hashes
    hot_c: np.ndarray  # their counts in training texts
    hot_of: np.ndarray  # their classes
    hot_worth: np.ndarray  # log10 P(word | its class)
    counts: DataFrame  # word, c, of, worth
    n: int
    v: int
    end_c: int


def _hot(counts: DataFrame, hot: int) -> DataFrame:
    """The words of the least count that at most ``hot`` words reach, from a histogram of powers of 1.1."""
    power = F.floor(F.log(F.col("every")) / F.log(F.lit(1.1)))
    least, reached = None, 0
    for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect():
        reached += r.n
        if reached > hot:
            break
        least = r.p
    return counts.where(power >= least) if least is not None else counts.where("false")


def _sorted(table) -> dict[str, np.ndarray]:
    """The columns of a pandas table in order of ``word``, an unsigned hash."""
    out = {c: table[c].to_numpy() for c in table.columns}
    out["word"] = out["word"].astype(np.int64).view(np.uint64)
    order = np.argsort(out["word"])
    return {c: x[order] for c, x in out.items()}


def train(
    docs: DataFrame, trained: Column, text_col: str = "text", units: int | None = None, classes: int = CLASSES, hot: int = HOT
) -> Model:
    """Learns from the rows where ``trained`` holds; counts words of all rows.

    ``units``: so many words alone get a class of their own; all words of the training texts where it is None.
    """
    rows = docs.select(F.coalesce(trained, F.lit(False)).alias("_trained"), F.col(text_col).cast("string").alias("_text"))
    counts = saved(_counts(rows.select(F.lit(0), F.col("_trained").cast("double"), "_text")), "word-counts")
    ends = rows.agg(F.count_if("_trained")).first()[0]
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    most = UNITS if units is None else units
    top = counts.where("c > 0").orderBy(F.desc("c"), F.expr("word < 0"), "word").limit(most).select("word", "shape", "c").toPandas()
    top = _sorted(top)
    own = Units(top["word"])
    pairs = _transitions(rows, own)
    of = exchange(pairs, classes)
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    if units is None:
        known, table, unit = _all_classed(rows, counts, own, of, table, hot, int(ends))
    else:
        known, unit = _grouped(counts, own, of, top, pairs, member)
    total, before = table.sum(axis=0), table.sum(axis=1)
    share = (total + 0.5) / (total.sum() + 0.5 * classes)
    step = np.log10((table + MIXED * share) / (before + MIXED)[:, None])
    words = _sorted(_hot(known, hot).select("word", "c", "of", "worth").toPandas())
    return Model(
        own, of, step, unit, words["word"], words["c"].astype(np.int64), words["of"].astype(np.int64), words["worth"].astype(np.float64),
        known.select("word", "c", "of", "worth"), int(n), int(v), int(ends),
    )


def _grouped(counts: DataFrame, own: Units, of: np.ndarray, top: dict, pairs: np.ndarray, member: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """All words with ``of`` and ``worth``, those that are no units by their groups, and what units are worth."""
    # Groups: what is left when the units' own words are taken out.
    group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in counts.where("c > 0").groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        group_n[r.shape], group_v[r.shape] = r.n, r.v
    np.subtract.at(group_n, top["shape"].astype(np.int64), top["c"])
    np.subtract.at(group_v, top["shape"].astype(np.int64), 1)
    unit = np.log10((pairs.sum(axis=0) + 0.5) / (member.T @ pairs.sum(axis=0) + 0.5 * member.sum(axis=0))[of])
    unit[1 + len(own.words) :] -= np.log10(group_n + group_v + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, shape, c = (batch.column(i).to_numpy() for i in range(3))
            number = own.at(word.view(np.uint64), shape)
            worth = unit[number] + np.where(number > len(own.words), np.log10(c + 1.0), 0.0)
            columns = [*batch.columns, pa.array(of[number]), pa.array(worth)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "of", "worth"])

    schema = "word long, shape long, c long, every long, of long, worth double"
    return counts.select("word", "shape", "c", "every").mapInArrow(work, schema), unit


def _all_classed(
    rows: DataFrame, counts: DataFrame, own: Units, of: np.ndarray, table: np.ndarray, hot: int, ends: int
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """All words with ``of`` and ``worth``, each by its own places, the transitions of their classes, and what units are worth."""
    classes = len(table)
    found = _assigned(_beside(rows, own, of, classes), table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = own.at(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            chosen = batch.column(4).fill_null(-1).to_numpy(zero_copy_only=False)
            classed = np.where((unit > len(own.words)) & (chosen >= 0), chosen, of[unit])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(classed)], names=["word", "shape", "c", "every", "of"])

    joined = counts.join(found, "word", "left").select("word", "shape", "c", "every", "found")
    known = saved(joined.mapInArrow(work, "word long, shape long, c long, every long, of long"), "word-classes")
    total, size = np.zeros(classes), np.zeros(classes)
    for r in known.where("c > 0").groupBy("of").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        total[r.of], size[r.of] = r.n, r.v
    # The end, and one unknown word of each group.
    total[of[0]] += ends
    size += np.bincount(np.append(of[1 + len(own.words) :], of[0]), minlength=classes)
    below = np.log10(total + 0.5 * size)
    c = np.zeros(own.size)
    c[0] = ends
    top = _sorted(known.where(F.col("word").isin(own.words.view(np.int64).tolist())).select("word", "c").toPandas())
    c[1 : 1 + len(own.words)] = top["c"]
    below_of = F.element_at(F.array(*map(F.lit, below.tolist())), F.col("of").cast("int") + 1)
    known = known.withColumn("worth", F.log10(F.col("c") + 0.5) - below_of)
    words = _sorted(_hot(known, hot).select("word", "c", "of", "worth").toPandas())
    model = Model(
        own, of, None, np.log10(c + 0.5) - below[of], words["word"], words["c"].astype(np.int64), words["of"].astype(np.int64),
        words["worth"].astype(np.float64), known.select("word", "c", "of", "worth"), 0, 0, ends,
    )
    texts = rows.where("_trained").select(F.monotonically_increasing_id().alias("row"), "_text", F.lit(None).cast("int").alias("_id"))
    first = of[0]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            codes, _ = _codes(batch)
            seen += np.bincount(np.concatenate([[first], codes[:-1]]) * classes + codes, minlength=classes * classes)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["pair", "n"])

    met = _classed(texts, model).select("codes", "others").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(classes * classes)
    for r in met:
        table[r.pair] = r.n
    return known, table.reshape(classes, classes), model.unit


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens of texts with ``codes`` and ``others``, and the texts' bounds."""
    codes, sizes = _items(batch.column(0), "<u2")
    codes, bounds = codes.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
    others = batch.column(1)
    fields = others.flatten()
    places, many = _items(fields.field("places"), "<i4")
    text = np.repeat(np.arange(len(others)), pc.list_value_length(others).fill_null(0).to_numpy(zero_copy_only=False))
    codes[np.repeat(bounds[text], many) + places] = np.repeat(fields.field("of").to_numpy(zero_copy_only=False).astype(np.int64), many)
    return codes, bounds


def _classed(rows: DataFrame, model: Model) -> DataFrame:
    """``_id, n_tokens, n_known, base, worth, codes, others`` of ``row, _text, _id``.

    ``worth`` is the sum of log10 P(word | its class), ``codes`` holds the class of each
    token as two bytes, but for the words that do not go along with the tasks:
    these are in ``others``, with their places.
    """
    # Plain arrays: what is broadcast is pickled by reference, and workers need not have this package.
    fields = (model.units.words, model.of, None, model.unit, model.hot, model.hot_c, model.hot_of, model.hot_worth, None, 0, 0, model.end_c)
    shared = rows.sparkSession.sparkContext.broadcast(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_units, *rest = shared.value
        splitter, m = _splitter(), Model(Units(words_of_units), *rest)
        plain = np.log10(m.hot_c + 1.0)
        for piece in slices(batches, 1):
            words = splitter.split(piece.column(1))
            texts = piece.num_rows
            # As unknown words of a group, until they are known.
            group = 1 + len(m.units.words) + shapes(words)
            of, worth = m.of[group], m.unit[group]
            at = np.minimum(np.searchsorted(m.hot, words.hashes), max(len(m.hot) - 1, 0))
            hot = m.hot[at] == words.hashes if len(m.hot) else np.zeros(len(words.hashes), dtype=bool)
            own = np.zeros(len(words.hashes))
            own[hot] = plain[at[hot]]
            seen = np.zeros(len(words.hashes), dtype=np.int64)
            seen[hot] = m.hot_c[at[hot]] > 0
            in_training = np.flatnonzero(seen)
            of[in_training], worth[in_training] = m.hot_of[at[in_training]], m.hot_worth[at[in_training]]
            sums = lambda x, b: np.diff(np.concatenate([[0], np.cumsum(x)])[b])
            codes, bounds = with_ends(of, words.bounds, m.of[0])
            columns = [
                np.diff(bounds),
                sums(seen, words.bounds) + (m.end_c > 0),
                sums(own, words.bounds) + np.log10(m.end_c + 1.0),
                sums(np.where(hot, worth, 0.0), words.bounds) + m.unit[0],
            ]
            rare = np.flatnonzero(~hot)
            row_of = np.searchsorted(words.bounds, rare, "right") - 1
            order = np.lexsort((words.hashes[rare], row_of))
            rare, row_of = rare[order], row_of[order]
            hashes = words.hashes[rare]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row_of[1:] != row_of[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare)))
            places = (rare - words.bounds[row_of]).astype("<i4")
            keys = piece.column(0)
            numbers = keys.to_numpy()
            none = pa.nulls(texts, pa.binary())
            # A text's own row meets no word in the join; its key only spreads such rows.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([keys, pa.array(numbers[row_of[first]])]),
                    pa.concat_arrays([piece.column(2), pa.nulls(len(first), piece.column(2).type)]),
                    pa.concat_arrays([pa.array(mix(numbers.view(np.uint64)).view(np.int64)), pa.array(hashes[first].view(np.int64))]),
                    pa.array(np.concatenate([np.zeros(texts, np.int64), times])),
                    *(pa.array(np.concatenate([x, np.zeros(len(first), x.dtype)])) for x in columns),
                    pa.concat_arrays([_binary(codes.astype("<u2"), np.diff(bounds)), pa.nulls(len(first), pa.binary())]),
                    pa.concat_arrays([none, _binary(places, times)]),
                    pa.array(np.concatenate([np.zeros(texts, np.int64), of[rare[first]]])),
                    pa.array(np.concatenate([np.zeros(texts), worth[rare[first]]])),
                ],
                names=["row", "_id", "word", "times", "n_tokens", "n_known", "base", "worth", "codes", "places", "group_of", "group_worth"],
            )

    id_type = rows.schema["_id"].dataType.simpleString()
    parts = rows.mapInArrow(
        work,
        f"row long, _id {id_type}, word long, times long, n_tokens long, n_known long, base double, worth double, "
        "codes binary, places binary, group_of long, group_worth double",
    )
    known = model.counts.where("c > 0").select("word", "c", F.col("of").alias("own_of"), F.col("worth").alias("own_worth"))
    met = parts.join(known, "word", "left")
    more = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    other = F.struct("places", F.coalesce("own_of", "group_of").alias("of"))
    return met.groupBy("row").agg(
        F.max("_id").alias("_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base"),
        F.sum(F.col("worth") + F.col("times") * F.coalesce("own_worth", "group_worth")).alias("worth"),
        F.max("codes").alias("codes"),
        F.collect_list(F.when(F.col("places").isNotNull(), other)).alias("others"),
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the model's log10 probability of the text, ``base_score`` that
    of single words with one count added. Nulls and empty texts are one end.
    Rows keep their number, whatever their ids; without training texts every
    token is unknown and the base score is 0.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"))
    step, first = model.step, int(model.of[0])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = _codes(batch)
            before = np.concatenate([[first], codes[:-1]])
            before[bounds[:-1]] = first  # each text begins after an end
            taken = np.add.reduceat(step[before, codes], bounds[:-1]) if len(codes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(taken)], names=[*batch.schema.names[2:], "taken"])

    classed = _classed(rows, model).select("codes", "others", "_id", "n_tokens", "n_known", "base", "worth")
    sums = classed.mapInArrow(steps, f"_id {id_type}, n_tokens long, n_known long, base double, worth double, taken double")
    total = float(np.log10(model.n + model.v + 1.0))
    return sums.select(
        F.col("_id").alias(id_col), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * total).alias("base_score"), (F.col("worth") + F.col("taken")).alias("score"),
    )
