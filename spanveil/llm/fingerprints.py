"""Document fingerprints by SpotSigs, and the likeness of neighbouring documents.

A signature is an anchor, one of the commonest words of a language, with the
content words that follow it; further common words in between are skipped. The
multiset of a text's signatures is its fingerprint (the n-th repeat of one is an
element of its own), written as sorted 8-digit hex numbers without separators.

- The start of a text is an anchor too, so a text with a content word has a
  signature.
- In stretches of more than GAP words without a common word (other languages,
  lists), the word of least hash of each GAP words is an anchor.
- Null and empty texts, and texts without words, have the empty fingerprint.
  Equal fingerprints are alike to 1.0, the empty one included; an empty and a
  filled one to 0.0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import slices
from spanveil.llm.words import Splitter, letters_digits, lower_az, mix, window_minima

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and a an to in is that for it on was with as are be this by at from or not "
    "der die das und ist in den von zu mit sich des auf für nicht als auch es dem ein eine im an werden aus "
    "le la les de des du et un une en est que dans qui pour par sur pas au plus avec ce il "
    "el los las y del que se por con no una su para es al lo como más o pero"
).split()
# Content words of a chain.
CHAIN = 2
# Words without an anchor, beyond which hashed anchors stand in.
GAP = 16


class Signatures:
    """Signature sets of a batch of texts; made once per task."""

    def __init__(self) -> None:
        self.splitter = Splitter(letters_digits(), lower_az())
        self.anchors = np.sort(self.splitter.split(pa.array(sorted(set(ANCHORS)))).hashes)

    def _common(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.anchors, hashes)
        return self.anchors[np.minimum(at, len(self.anchors) - 1)] == hashes

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """A sorted array of distinct 32-bit signatures per text."""
        words = self.splitter.split(pa.array(texts, pa.large_string()))
        hashes, bounds = words.hashes, words.bounds
        n = len(hashes)
        if not n:
            return [np.zeros(0, np.uint32)] * len(texts)
        common = self._common(hashes)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # Stretches without common words, from the places where they or the texts end.
        stops = np.unique(np.concatenate([bounds, np.flatnonzero(common), np.flatnonzero(common) + 1]))
        chosen = np.zeros(n, dtype=bool)
        for k in np.flatnonzero(np.diff(stops) > GAP):
            chosen[stops[k] + window_minima(hashes[stops[k] : stops[k + 1]], GAP)] = True
        content = np.flatnonzero(~common)
        filled = np.flatnonzero(np.diff(bounds))
        # Anchors: the start of each text, then common words and chosen words.
        after = np.concatenate([bounds[filled], np.flatnonzero(common | chosen) + 1])
        owner = np.concatenate([filled, row[common | chosen]])
        spelt = np.concatenate([np.full(len(filled), 1, np.uint64), hashes[common | chosen]])
        contents = np.searchsorted(content, bounds)
        end = contents[owner + 1]
        first = np.searchsorted(content, after)
        # A text of common words alone has its anchors for signatures.
        used = (first < end) | (np.diff(contents) == 0)[owner]
        first, end, spelt, owner = first[used], end[used], spelt[used], owner[used]
        for step in range(CHAIN):
            at = first + step
            there = at < end
            spelt[there] = mix(spelt[there] * np.uint64(3) + hashes[content[at[there]]])
        # A repeated signature stands for itself once per repeat, by its number.
        order = np.lexsort((spelt, owner))
        spelt, owner = spelt[order], owner[order]
        place = np.arange(len(spelt))
        new = np.ones(len(spelt), dtype=bool)
        new[1:] = (spelt[1:] != spelt[:-1]) | (owner[1:] != owner[:-1])
        number = place - np.maximum.accumulate(np.where(new, place, 0))
        spelt = mix(spelt + number.astype(np.uint64))
        values = (spelt >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.unique(values[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]


def spelt_out(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_class(n: int, least: float) -> int:
    """Sets whose Jaccard value reaches ``least`` are in the same or in neighbouring classes."""
    return int(np.floor(np.log(n) / -np.log(least) + 1e-9)) if n and 0 < least < 1 else 0


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard value of two sorted sets, or 0.0 where it cannot reach ``least``.

    Sets in length partitions more than one apart, or whose lengths alone rule
    ``least`` out, are not compared. With ``least`` 0 the value is exact.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if not len(a) or a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    if length_class(len(b), least) - length_class(len(a), least) > 1 or len(a) < least * len(b):
        return 0.0
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``fingerprint`` of every text; one pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        for piece in slices(batches, 1):
            found = [spelt_out(x) for x in signatures.of(piece.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.string())], names=["_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, fingerprint string").withColumnRenamed("_id", id_col)


def likeness(one: Column, other: Column, least: float = 0.0) -> Column:
    """Pruned Jaccard value of two fingerprint columns; null where one is null."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda text: np.frombuffer(bytes.fromhex(text), dtype=">u4")
        return pd.Series([None if x is None or y is None else pruned_jaccard(read(x), read(y), least) for x, y in zip(a, b)], dtype="float64")

    return compare(one, other)


def in_descending_order(docs: DataFrame, parts: int) -> DataFrame:
    """Columns ``_id, _text`` plus ``_part, _lent``, dealt to ``parts`` sorted partitions.

    Ids are cut into ranges at approximate quantiles. Each range, in descending
    order of id, is followed by a lent copy (``_lent`` 1) of the first row of
    the next lower range that has rows; the lowest is followed by the first row
    of all. So every row has its successor in its own partition. To the driver
    go one cut and one id per range.

    Null ids come after all others. Rows of one id are in order of their texts.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = []
    if shares:
        found = docs.agg(F.percentile_approx("_id", shares, max(10_000, 20 * parts)).alias("cuts")).first().cuts
        cuts = sorted(set(found or []))
    edges = np.array(cuts, dtype=np.int64)

    def part_of(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int64)
        out[known] = np.searchsorted(edges, ids[known].to_numpy(dtype=np.int64), "right")
        return out

    part = F.pandas_udf(lambda ids: pd.Series(part_of(ids)), "long")
    heads = docs.select("_id", part("_id").alias("_part")).groupBy("_part").agg(F.max("_id").alias("_id"))
    first = sorted(((r._part, r._id) for r in heads.collect()), reverse=True)
    lent: dict[int | None, int] = {}
    for i, (_, head) in enumerate(first):
        lent[head] = first[i - 1][0]  # the range above; for the uppermost, the lowest

    @F.pandas_udf("array<long>")
    def parts_of(ids: pd.Series) -> pd.Series:
        own = part_of(ids)
        keys = [None if pd.isna(x) else int(x) for x in ids]
        return pd.Series([[int(p), lent[k]] if k in lent else [int(p)] for p, k in zip(own, keys)])

    return (
        docs.select("_id", "_text", F.posexplode(parts_of("_id")).alias("_lent", "_part"))
        .select("_id", "_text", "_lent", F.col("_part").cast("int").alias("_part"))
        .repartitionById(parts, F.col("_part"))
        .sortWithinPartitions("_part", "_lent", F.desc("_id"), "_text")
    )


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and the next.

    The next document is that of the next lower id; the lowest has the highest
    as its next. The edited text has the last third of the code points, rounded
    down, replaced by as many from the start of the next document, or all of
    them. Texts cross the network once.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. A table of one row
    is its own next; an empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        waiting: tuple | None = None
        for piece in slices(batches, 1):
            ids, texts, lent, part = (piece.column(i).to_pylist() for i in range(4))
            here = list(zip(ids, texts, lent, part))
            if waiting is not None:
                here.insert(0, waiting)
            waiting = here[-1]
            pairs = [i for i in range(len(here) - 1) if not here[i][2]]
            found = signatures.of([x[1] for x in here])
            edited = []
            for i in pairs:
                text, third = here[i][1], len(here[i][1]) // 3
                edited.append(text[: len(text) - third] + here[i + 1][1][:third])
            found_edited = signatures.of(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([here[i][0] for i in pairs], pa.int64()),
                    pa.array([len(here[i][1]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array([spelt_out(found[i]) for i in pairs], pa.string()),
                    pa.array([spelt_out(x) for x in found_edited], pa.string()),
                    pa.array([pruned_jaccard(found[i], x) for i, x in zip(pairs, found_edited)], pa.float64()),
                    pa.array([pruned_jaccard(found[i], found[i + 1]) for i in pairs], pa.float64()),
                ],
                names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = (
        "_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return in_descending_order(rows, parts).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
