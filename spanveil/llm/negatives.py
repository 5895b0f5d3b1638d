"""Hard negatives of anchors, searched with rotated one-bit codes and exact intervals.

A vector becomes integers, floor(256 * x). Turned by a fixed rotation it is
written as a sum of one-bit codes: the signs of what is left, times their
alignment with it (the inner product with the unit sign vector), and a residual
that is orthogonal to the last code. Of a pair, the inner product with each code
follows from popcounts of the code with the bit planes of the rotated, rounded
query. What the residual can add or take is bounded by Cauchy-Schwarz, and what
the rounding can by its absolute sum, so the interval of a pair's score is sure.
Codes are read one after the other while the interval can still matter; pairs
whose interval survives all of them are scored in integers. Nothing is lost and
every score is exact.

Rows of an anchor search: rows go to groups of bounded size by a hash of the
whole row, and each anchor visits each group. A task holds the rows of one group
and streams the anchors past them; the best of each group are merged by window.
This is the work of anchors times rows, in blocks; nothing is broadcast.

Rows with a null id, label or vector, or with a component that is null, not
finite, or so large that a score might not fit a long (about 1.4 million in 64
dimensions), take no part. Vectors of different length: missing components are
zeros. Exact repeats of a row count once; rows that share an id and differ are
rows of their own, but none is a positive or negative of an anchor of that id.
Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import saved

# One-bit codes per vector, bits of a rounded query component, rounds of the rotation.
CODES, PLANES, ROUNDS = 6, 8, 3
# Rows, as a multiple of those asked for, that are scored early to learn how good the first ones are.
PROBED = 4
# Codes after which this is done.
PROBES = (1, 3)
# Rows that a task holds at a time, at most about so many.
GROUP_ROWS = 1 << 16
# What the counts of set bits, and of each plane, add to the sums of bits and of rounded components.
WEIGHTS = np.array([[1] + [0] * PLANES, [0] + [1 << b for b in range(PLANES)]], dtype=np.float32)
# Relative allowance for the rounding of floating point sums.
SLACK = 1e-9


def rotated(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``x`` with zeros up to ``width`` (a power of two), turned by sign flips and Hadamard transforms."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    flips = np.random.Generator(np.random.PCG64(20)).integers(0, 2, (ROUNDS, width)) * 2.0 - 1.0
    for flip in flips:
        out *= flip
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            a, b = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :]
            pairs[:, :, 0, :] += b
            np.subtract(a, b, out=pairs[:, :, 1, :])
            step *= 2
        out /= math.sqrt(width)
    return out


def width_of(size: int) -> int:
    return max(64, 1 << (max(size, 1) - 1).bit_length())


def packed(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as words of 64 bits."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, code, word) and fits (row, code, [alignment, norm of the residual])."""
    width = width_of(values.shape[1])
    left = rotated(values, width)
    codes = np.empty((len(left), CODES, width // 64), dtype=np.uint64)
    fits = np.empty((len(left), CODES, 2))
    for k in range(CODES):
        signs = left >= 0
        codes[:, k] = packed(signs)
        align = np.abs(left).sum(axis=1) / math.sqrt(width)
        left = left - np.where(signs, 1.0, -1.0) * (align / math.sqrt(width))[:, None]
        fits[:, k, 0], fits[:, k, 1] = align, np.sqrt((left * left).sum(axis=1))
    return codes, fits


class Query:
    """A query vector, rotated, rounded to ``PLANES`` bits and cut into bit planes."""

    def __init__(self, values: np.ndarray, y: np.ndarray) -> None:
        """``y``: the values, rotated."""
        self.values = values
        self.norm = math.sqrt(float((values.astype(np.float64) ** 2).sum()))
        self.width = len(y)
        self.low = float(y.min())
        self.unit = (float(y.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        units = np.rint((y - self.low) / self.unit).astype(np.int64)
        self.total = int(units.sum())
        self.error = float(np.abs(y - (self.low + self.unit * units)).sum()) / math.sqrt(self.width)
        planes = [packed(((units >> b) & 1).astype(bool)[None])[0] for b in range(PLANES)]
        # By word of a code: all bits, and each plane, as columns.
        self.masks = np.stack([np.full(self.width // 64, ~np.uint64(0)), *planes], axis=1)[:, :, None]

    def along(self, code: np.ndarray) -> np.ndarray:
        """Inner products of the rounded query with the unit sign vectors of ``code`` (word, row)."""
        sums = np.zeros((2, code.shape[1]), dtype=np.float32)
        for words, masks in zip(code, self.masks):
            # Whole numbers far below 2**24, which single precision holds exactly.
            sums += WEIGHTS @ np.bitwise_count(words & masks).astype(np.float32)
        # The sum of (low + unit * u) * sign, where a sign is 2 * bit - 1.
        shift = -self.low * self.width - self.unit * self.total
        ones, units = sums.astype(np.float64)
        return (self.low * 2 * ones + self.unit * 2 * units + shift) / math.sqrt(self.width)


def queries(values: np.ndarray) -> list[Query]:
    return [Query(v, y) for v, y in zip(values, rotated(values.astype(np.float64), width_of(values.shape[1])))]


class Rows:
    """The rows of a group, by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, codes: np.ndarray, fits: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        # Codes by (word, row); fits by alignment, norm of the residual, and sum of the alignments so far.
        sums = np.cumsum(fits[:, :, 0], axis=1)
        self.codes = [np.ascontiguousarray(codes[order, k].T) for k in range(CODES)]
        self.fits = [np.ascontiguousarray(np.stack([fits[order, k, 0], fits[order, k, 1], sums[order, k]])) for k in range(CODES)]
        self.norms = np.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1))

    def of_label(self, label: int) -> np.ndarray:
        return np.arange(*np.searchsorted(self.labels, [label, label + 1]))

    def of_others(self, label: int) -> np.ndarray:
        first, last = np.searchsorted(self.labels, [label, label + 1])
        return np.concatenate([np.arange(first), np.arange(last, len(self.labels))])

    def scores(self, query: Query, at: np.ndarray) -> np.ndarray:
        """Integer inner products; through doubles where these are exact."""
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        if query.norm * float(self.norms[at].max()) < 2.0**52:
            return np.rint(self.values[at].astype(np.float64) @ query.values.astype(np.float64)).astype(np.int64)
        return (self.values[at].astype(np.int64) * query.values.astype(np.int64)).sum(axis=1)

    def best(
        self, query: Query, at: np.ndarray, windows: list[tuple[float, float]], k: int
    ) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Of rows ``at``, the ids and scores of the first k in each window (low, high), and the pairs scored."""
        estimate = np.zeros(len(at))
        floors = [low for low, _ in windows]
        probed = 0
        for level, (code, fit) in enumerate(zip(self.codes, self.fits)):
            if len(at) <= PROBED * k:
                break
            along = query.along(code[:, at])
            estimate = estimate + fit[0, at] * along
            across = np.sqrt(np.maximum(query.norm**2 - np.maximum(np.abs(along) - query.error, 0.0) ** 2, 0.0))
            # All alignments so far carry the query's rounding.
            half = across * fit[1, at] + fit[2, at] * query.error + SLACK * (1.0 + query.norm * self.norms[at])
            least, most = estimate - half, estimate + half
            if level in PROBES:
                # Scores of a few rows that seem to be first: no row below k scores inside is among the first k.
                order = np.argsort(estimate)
                ends = np.searchsorted(estimate, [high for _, high in windows], "right", sorter=order)
                probe = order[np.unique(np.maximum(ends[:, None] - np.arange(1, PROBED * k + 1), 0))]
                scores = self.scores(query, at[probe])
                probed += len(probe)
                for w, (low, high) in enumerate(windows):
                    inside = np.sort(scores[(scores >= low) & (scores <= high)])
                    if len(inside) >= k:
                        floors[w] = max(floors[w], int(inside[-k]))
            keep = np.zeros(len(at), dtype=bool)
            for floor, (_, high) in zip(floors, windows):
                keep |= (most >= floor) & (least <= high)
            at, estimate = at[keep], estimate[keep]
        scores = self.scores(query, at)
        found = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            first = inside[np.lexsort((self.ids[at[inside]], -scores[inside]))[:k]]
            found.append((self.ids[at[first]], scores[first]))
        return found, len(at) + probed


def _flat(column: pa.Array, dtype: type, rows: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(rows, -1)


def coded(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v, code, fit`` of the rows of (vec_id, label, embedding) that take part, each once; written."""
    whole = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(
        "forall(embedding, x -> x IS NOT NULL AND abs(x) <= 1.7976931348623157E308D)"
    )
    size = max(whole.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    # size * top * top fits a long, and a component four bytes.
    top = min(math.isqrt((2**63 - 1) // size), 2**31 - 1)
    schema = "vec_id long, label long, v binary, code binary, fit binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(start, 4096)
                lists = batch.column(2)
                lengths = np.diff(np.asarray(lists.offsets))
                flat = np.asarray(lists.flatten(), dtype=np.float64)
                values = np.zeros((batch.num_rows, size))
                values[np.repeat(np.arange(len(lengths)), lengths), _places(lengths)] = np.floor(256 * flat)
                fits_long = np.abs(values).max(axis=1, initial=0) <= top
                batch = batch.filter(pa.array(fits_long))
                if not batch.num_rows:
                    continue
                values = values[fits_long]
                codes, fits = encode(values)
                binary = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (values.astype(np.int32), codes, fits)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *binary], names=["vec_id", "label", "v", "code", "fit"]
                )

    done = whole.select("vec_id", "label", F.col("embedding").cast("array<double>")).mapInArrow(run, schema)
    return saved(done.distinct(), "negatives-codes")


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the lists of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _searched(index: DataFrame, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """``anchor, goal, vec_id, score``: the first k of each group, for each anchor and each of its ``goals``.

    ``anchors`` has ``anchor, vec_id, label, v, goals``, where a goal gives the
    scores asked for: [goal * low, goal * high], both ends as numbers. ``same``
    tells whether rows of the anchor's label are searched, or all others.
    """
    rows = index.select(
        F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(groups)).cast("int").alias("cell"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("anchor"),
        "vec_id",
        "label",
        "v",
        "code",
        "fit",
        F.lit(None).cast("array<struct<goal:long,low:long,high:long>>").alias("goals"),
    )
    visits = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"),
        F.lit(1).alias("kind"),
        "anchor",
        "vec_id",
        "label",
        "v",
        F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("binary").alias("fit"),
        "goals",
    )
    cells = rows.unionByName(visits).repartition(groups, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held = None, [], None
        for batch in batches:
            cells_of, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(cells_of) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(cells_of)]):
                if cells_of[start] != cell:
                    cell, waiting, held = cells_of[start], [], None
                piece = batch.slice(start, end - start)
                if kinds[start] == 0:
                    n = piece.num_rows
                    values, codes = _flat(piece.column(5), np.int32, n), _flat(piece.column(6), np.uint64, n)
                    fits = _flat(piece.column(7), np.float64, n)
                    waiting.append(
                        (np.asarray(piece.column(3)), np.asarray(piece.column(4)), values,
                         codes.reshape(n, CODES, -1), fits.reshape(n, CODES, 2))
                    )
                    continue
                if held is None:
                    if not waiting:
                        continue
                    held, waiting = Rows(*(np.concatenate(parts) for parts in zip(*waiting))), []
                yield from visited(held, piece)

    def visited(held: Rows, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [[], [], [], []]
        vectors = _flat(piece.column(5), np.int32, piece.num_rows)
        visitors = zip(*(piece.column(i).to_pylist() for i in (2, 3, 4, 8)), queries(vectors))
        for anchor, vec_id, label, goals, query in visitors:
            at = held.of_label(label) if same else held.of_others(label)
            at = at[held.ids[at] != vec_id]
            windows = [
                (-math.inf if g["low"] is None else g["low"], math.inf if g["high"] is None else g["high"]) for g in goals
            ]
            found, _ = held.best(query, at, windows, k)
            for g, (ids, scores) in zip(goals, found):
                out[0].append(np.full(len(ids), anchor))
                out[1].append(np.full(len(ids), g["goal"]))
                out[2].append(ids)
                out[3].append(scores)
        columns = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "goal", "vec_id", "score"])

    return cells.mapInArrow(run, "anchor long, goal long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of an anchor and goal, of all groups, with their ``rank``."""
    rank = F.expr("row_number() OVER (PARTITION BY anchor, goal ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column | str,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 3,
    share: tuple[int, int] = (50, 95),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on ``vec_id``. The positives of an anchor are the
    first rows of its label by score; the negatives of a positive the first rows
    of other labels whose score is between ``share`` hundredths of the positive's.
    """
    named = F.col(label) if isinstance(label, str) else label
    rows = embeddings.select(
        F.col(key).cast("long").alias("vec_id"), named.cast("long").alias("label"), F.col(vector).alias("embedding")
    )
    index = coded(rows)
    total = index.count()
    groups = max(1, -(-total // GROUP_ROWS), min(-(-total // 2048), 2 * embeddings.sparkSession.sparkContext.defaultParallelism))
    asked = index.where(anchor).select(F.xxhash64("vec_id", "label", "v").alias("anchor"), "vec_id", "label", "v")
    anything = F.expr("array(named_struct('goal', 0L, 'low', cast(NULL AS long), 'high', cast(NULL AS long)))")
    near = _first(_searched(index, asked.withColumn("goals", anything), groups, True, positives), positives)
    pairs = saved(near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")), "negatives-positives")
    # Scores s of 50 p <= 100 s <= 95 p, in whole numbers.
    low, high = (F.expr(f"cast({rounding}({edge} * cast(goal AS decimal(19)) / 100) AS long)") for rounding, edge in (("ceil", share[0]), ("floor", share[1])))
    goals = (
        pairs.select("anchor", "goal")
        .distinct()
        .select("anchor", F.struct("goal", low.alias("low"), high.alias("high")).alias("window"))
        .where("window.low <= window.high")
        .groupBy("anchor")
        .agg(F.collect_list("window").alias("goals"))
    )
    far = _first(_searched(index, asked.join(goals, "anchor"), groups, False, negatives), negatives)
    ids = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (
        far.select("anchor", "goal", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["anchor", "goal"])
        .join(ids, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            F.col("goal").alias("positive_score"),
            "negative_score",
        )
    )
