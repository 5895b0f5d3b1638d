"""Quality scores by positive-unlabelled learning.

Positives are documents labelled good; the unlabelled set is a sample of all
documents, good or bad, whatever their labels. With the class prior p, the share
of good documents, the risk of a scorer g is

    p * E_pos[loss(g, +1)] + max(0, E_unl[loss(g, -1)] - p * E_pos[loss(g, -1)])

whose second part is the unbiased risk on negatives, kept from going below zero.
Where a step finds it below zero, it climbs out along that part alone. Labels of
bad documents are not used at all: the prior, too, is estimated from positives
and unlabelled rows (`class_prior`).

A document is described by shares and ratios of its whole text: letter case,
symbols, repeated words and word runs. Language and length of a text are left
out on purpose. Each feature is cut into bins at quantiles of the sample; the
scorer is linear in the bins.

Bounds: FIT_ROWS positives and FIT_ROWS unlabelled rows, chosen by hash of their
ids, are fitted on the driver as numbers (not texts). Scores are over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import filtered, slices
from spanveil.llm.words import Runs, Splitter, not_space

# Rows of each kind in the fit.
FIT_ROWS = 20_000
# Steps of gradient descent, and its rate.
STEPS, RATE, SHRINK = 600, 0.1, 2e-4
# Chance that the prior's error is larger than allowed for.
CHANCE = 0.1
# Cut points of each feature: quantiles of the unlabelled sample's values below
# and above the median, so that a feature that is mostly zero has cuts too.
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95)
RUN = 4
FEATURES = (
    "upper", "symbols", "bars", "exclamations", "same_as_before", "repeated_words", "repeated_runs",
    "digits", "word_bytes", "stops",
)


def fold_of(id_col: str, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def _byte_classes() -> dict[str, np.ndarray]:
    def table(chars: str | bytes) -> np.ndarray:
        out = np.zeros(256, dtype=bool)
        out[list(chars.encode() if isinstance(chars, str) else chars)] = True
        return out

    return {
        "upper": table(bytes(range(0x41, 0x5B))),
        "letters": table(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))),
        "symbols": table("#$%&*+/<=>@\\^_`{}~"),
        "bars": table("|"),
        "exclamations": table("!"),
        "digits": table("0123456789"),
    }


class Describer:
    """Feature rows of a batch of texts; made once per task."""

    def __init__(self) -> None:
        self.splitter = Splitter(not_space())
        self.runs = Runs()
        self.classes = _byte_classes()

    def of(self, texts: pa.Array) -> np.ndarray:
        words = self.splitter.split(texts)
        sizes = np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        counts = {}
        for name, table in self.classes.items():
            # One byte per byte of text, however long a text is.
            inside = table[words.data]
            counts[name] = np.array([np.count_nonzero(inside[e - n : e]) for e, n in zip(ends, sizes)], dtype=np.int64)
        size, n = np.maximum(sizes, 1), np.diff(words.bounds)
        some = np.maximum(n, 1)
        out = np.zeros((len(texts), len(FEATURES)))
        for i in range(len(texts)):
            low, high = words.bounds[i], words.bounds[i + 1]
            hashes = words.hashes[low:high]
            if not len(hashes):
                continue
            lengths = words.ends[low:high] - words.begins[low:high]
            grams = self.runs.grams(hashes, RUN)
            distinct = len(np.unique(hashes))
            out[i, 4] = np.count_nonzero(hashes[1:] == hashes[:-1]) / len(hashes)
            out[i, 5] = 1 - distinct / len(hashes) ** 0.85
            out[i, 6] = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
            out[i, 8] = lengths.mean()
            out[i, 9] = np.count_nonzero(words.data[words.ends[low:high] - 1] == 0x2E) / len(hashes)
        out[:, 0] = counts["upper"] / np.maximum(counts["letters"], 1)
        out[:, 1] = counts["symbols"] / size
        out[:, 2] = counts["bars"] / some
        out[:, 3] = counts["exclamations"] / some
        out[:, 7] = counts["digits"] / size
        return out


@dataclass
class Scorer:
    cuts: list[np.ndarray]
    weights: np.ndarray

    def bins(self, features: np.ndarray) -> np.ndarray:
        """Per feature the number of its bin, as a column of the weight vector."""
        out = np.empty(features.shape, dtype=np.int64)
        first = 1
        for j, cuts in enumerate(self.cuts):
            out[:, j] = first + np.searchsorted(cuts, features[:, j], "right")
            first += len(cuts) + 1
        return out

    def margin(self, features: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[self.bins(features)].sum(axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features), -40, 40)))


def cut_points(values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(0)
    middle = np.median(values)
    tails = [values[values < middle], values[values > middle]]
    return np.unique(np.concatenate([np.quantile(x, QUANTILES) for x in tails if len(x)] or [np.zeros(0)]))


def _blank(sample: np.ndarray, start: float) -> Scorer:
    cuts = [cut_points(column) for column in sample.T]
    scorer = Scorer(cuts, np.zeros(1 + sum(len(c) + 1 for c in cuts)))
    scorer.weights[0] = start
    return scorer


def _gradient(bins: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    """Mean over rows of a slope in the margin, as one in the weights."""
    per_row = slope / len(bins)
    out = np.bincount(bins.ravel(), np.repeat(per_row, bins.shape[1]), size)
    out[0] = per_row.sum()
    return out


def _descend(scorer: Scorer, slope_of: Callable[[np.ndarray], np.ndarray]) -> None:
    """Adam, with the bins' weights shrunk."""
    size = len(scorer.weights)
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        w = scorer.weights
        slope = slope_of(w) + SHRINK * np.concatenate([[0.0], w[1:]])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        scorer.weights = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the best bin of a classifier that tells the two apart.

    Of rows scored at least t, the unlabelled share is at least the prior times
    the positive share, whatever t; the ratio of the two shares is the prior where
    no negative is scored so high. The classifier is fitted on one half of the
    rows; the threshold is the one on the other half that makes the ratio plus
    its chance error least. Without positives or unlabelled rows it is one half.
    """
    (pos, pos_held), (unl, unl_held) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    if not len(pos_held) or not len(unl_held):
        return 0.5
    scorer = _blank(unl, 0.0)
    in_pos, in_unl = scorer.bins(pos), scorer.bins(unl)

    def logistic(w: np.ndarray) -> np.ndarray:
        s_pos, s_unl = (1 / (1 + np.exp(-(w[0] + w[x].sum(axis=1)))) for x in (in_pos, in_unl))
        return _gradient(in_pos, s_pos - 1, len(w)) + _gradient(in_unl, s_unl, len(w))

    _descend(scorer, logistic)
    of_pos, of_unl = np.sort(scorer.margin(pos_held)), np.sort(scorer.margin(unl_held))
    share_pos = 1 - np.searchsorted(of_pos, of_pos) / len(of_pos)
    share_unl = 1 - np.searchsorted(of_unl, of_pos) / len(of_unl)
    error = sum(np.sqrt(np.log(4 / CHANCE) / (2 * len(x))) for x in (of_pos, of_unl))
    best = int(np.argmin((share_unl + error) / share_pos))
    return float(np.clip(share_unl[best] / share_pos[best], 0.02, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Minimises the non-negative risk. The loss is the sigmoid of -y * g, which is bounded."""
    scorer = _blank(unlabelled if len(unlabelled) else positive, np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return scorer
    in_pos, in_unl = scorer.bins(positive), scorer.bins(unlabelled)
    _descend(scorer, lambda w: risk_slope(w, in_pos, in_unl, prior))
    return scorer


def risk_slope(w: np.ndarray, in_pos: np.ndarray, in_unl: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the risk in the weights, or the way out where its second part is negative."""
    s_pos, s_unl = (1 / (1 + np.exp(-(w[0] + w[x].sum(axis=1)))) for x in (in_pos, in_unl))
    steep_pos = _gradient(in_pos, s_pos * (1 - s_pos), len(w))
    on_negative = _gradient(in_unl, s_unl * (1 - s_unl), len(w)) - prior * steep_pos
    return -on_negative if s_unl.mean() - prior * s_pos.mean() < 0 else on_negative - prior * steep_pos


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer()
        for piece in slices(batches, 1):
            rows = describer.of(piece.column(1))
            bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            lists = pa.ListArray.from_arrays(bounds, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["_kind", "features"])

    rows = docs.select(F.col(id_col).alias("_kind"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_kind int, features array<double>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1
) -> Scorer:
    """Fits on rows whose fold is not ``held_out``.

    ``labels`` has the id and ``quality``; only those that say good (1) count,
    whatever other labels an id has. Without any the prior is one half and every
    score is one half.
    """
    trained = F.coalesce(fold_of("_id", folds) != held_out, F.lit(False))
    good = labels.where(F.col("quality").cast("int") == 1).select(F.col(id_col).alias("_id")).where(trained).distinct()
    by_hash = F.xxhash64(F.col("_id"), F.lit("quality"))
    positive = good.orderBy(by_hash, "_id").limit(FIT_ROWS)
    ids = docs.select(F.col(id_col).alias("_id")).where(trained)
    unlabelled = ids.orderBy(by_hash, "_id").limit(FIT_ROWS)
    # At most 2 * FIT_ROWS ids, so the texts stay where they are.
    chosen = positive.withColumn("_kind", F.lit(1)).union(unlabelled.withColumn("_kind", F.lit(0)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _features(texts.join(F.broadcast(chosen), "_id"), "_kind", "_text").toPandas()
    features = np.array(rows["features"].tolist()).reshape(-1, len(FEATURES))
    kind = rows["_kind"].to_numpy()
    # In an order of their own, so that sums do not depend on that of the rows.
    positives, others = (x[np.lexsort(x.T)] for x in (features[kind == 1], features[kind == 0]))
    return fit_pu(positives, others, class_prior(positives, others))


def score_quality(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on).

    Null and empty texts are scored by the bins that an empty text falls into.
    Rows keep their number. No exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer()
        for piece in slices(batches, 1):
            scores = scorer.score(describer.of(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], names=["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"_id {id_type}, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is scored 0.5 or more. No exchange."""

    def make():
        describer = Describer()
        return lambda texts: scorer.score(describer.of(texts)) >= 0.5

    return filtered(docs, text_col, make)
