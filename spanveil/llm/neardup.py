"""Near-duplicate documents by one-permutation MinHash, confirmed on full sets.

A document's set holds its distinct runs of ``shingle`` words (A-Z lowered); a
text of fewer words is one run. One hash function deals a set to BINS bins, the
least hash of each is kept, and empty bins borrow from filled ones in an order
that depends on the bin alone (optimal densification). BANDS groups of ROWS bins
give the buckets. Two sets that share the least allowed 0.8 miss all of 32
buckets of 4 bins with a chance of 5e-8.

From sets to links:

1. Documents with equal sets are one class from here on.
2. Each bucket gives star-shaped edges: from its members to its least id, and to
   one further member that a bucket-dependent order picks. So a bucket of n
   classes gives less than 2n candidate pairs, which join most of what is alike.
3. The edge to the least hub of each class is confirmed on the full sets first.
   Edges whose ends are connected by then cannot change a component; all others
   are confirmed in a second pass.
4. Buckets that hold more than one component by then are looked into. One with at
   most GROUP classes outside of its largest component gives its pairs across
   components. Larger ones that share classes make one group, and a group is divided
   in rounds:
   its smallest set is the hub, with which all others are compared. Two sets that
   are alike and not both alike to the hub share a shingle that the hub lacks,
   since neither is smaller than the hub. So the group is divided by the shingles
   that the hub lacks: one that at most PAIRED classes have gives their pairs, and
   classes that commoner ones join make the groups of the next round.
   Bit maps of both sets bound what a pair can share from above; pairs that may
   still reach the least share are confirmed.

So every two classes that share a bucket are connected or were compared, and no
bucket is cut, capped or gathered in one task. What a template has in common goes
with its hub, so a template group does not give all its pairs; a large group that
ROUNDS hubs do not divide does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import components
from spanveil.llm.tables import saved, slices
from spanveil.llm.words import Runs, Splitter, lower_az, mix, not_space

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
LEAST = 80  # percent
MAP = 16  # longs of a set's bit map
GROUP = 4096  # classes outside of the main component of a bucket or group that are paired with all of it
PAIRED = 32  # classes with a shingle that are paired
ROUNDS = 3  # hubs that a large group is divided by


class Sketcher:
    """Shingle sets and band hashes of a batch of texts; made once per task."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle
        self.splitter = Splitter(not_space(), lower_az())
        self.runs = Runs()
        self.edges = np.arange(BINS + 1, dtype=np.float64) * 2.0 ** (64 - int(np.log2(BINS)))
        self.edges = np.array([int(x) for x in self.edges[:-1]], dtype=np.uint64)
        self.bases = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words = self.splitter.split(texts)
        out = []
        for i in range(len(texts)):
            hashes = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            out.append(np.unique(self.runs.grams(hashes, min(self.shingle, len(hashes)))) if len(hashes) else hashes)
        return out

    def bins(self, members: np.ndarray) -> np.ndarray:
        """Least hash of each bin of a sorted set that is not empty; empty bins densified."""
        at = np.searchsorted(members, self.edges)
        value = members[np.minimum(at, len(members) - 1)]
        filled = at < np.append(at[1:], len(members))
        out = np.where(filled, value, np.uint64(0))
        empty = np.flatnonzero(~filled).astype(np.uint64)
        attempt = 0
        while len(empty):
            attempt += 1
            lender = (mix(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
            lent = filled[lender]
            out[empty[lent].astype(np.int64)] = value[lender[lent]]
            empty = empty[~lent]
        return out

    def bands(self, members: np.ndarray) -> np.ndarray:
        rows = self.bins(members).reshape(BANDS, ROWS)
        key = self.bases.copy()
        for j in range(ROWS):
            key = mix(key * np.uint64(3) + rows[:, j])
        return key.view(np.int64)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for piece in slices(batches, 1):
            sets = sketcher.sets(piece.column(1))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [sketcher.bands(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["_id", "n", "key", "bands"],
            )

    return rows.mapInArrow(run, "_id long, n long, key binary, bands array<long>")


def _full_sets(rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id``, ``members``, ``m0``, ``m1``, ... (bit map) of the documents whose ids are in ``ids``."""
    places = [f"m{k}" for k in range(MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for piece in slices(batches, 1):
            sets = sketcher.sets(piece.column(1))
            bits = np.zeros((len(sets), MAP * 64), dtype=np.uint8)
            for i, s in enumerate(sets):
                bits[i, (s % np.uint64(MAP * 64)).astype(np.int64)] = 1
            maps = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *(pa.array(maps[:, k].copy()) for k in range(MAP))],
                names=["id", "members", *places],
            )

    kept = rows.join(ids.hint("shuffle_hash"), rows["_id"] == ids["id"], "left_semi")
    return kept.mapInArrow(run, "id long, members array<long>" + "".join(f", {m} long" for m in places))


def _confirmed(edges: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The edges whose sets share at least ``least`` percent."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return edges.join(right, "b").join(left, "a").where(100 * both >= least * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


_MAPS = [f"m{k}" for k in range(MAP)]


def _hopeful(pairs: DataFrame, placed: DataFrame, least: int) -> DataFrame:
    """Of pairs ``a, b`` those of different components whose bit maps may share ``least`` percent."""
    side = lambda x: placed.select(F.col("rep").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "component", *_MAPS)))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{m}")))) for m in _MAPS), F.lit(0))
    most = F.least(F.col("a_n") - only("a", "b"), F.col("b_n") - only("b", "a"))
    able = (F.col("a_component") != F.col("b_component")) & ((100 + least) * most >= least * (F.col("a_n") + F.col("b_n")))
    return both.where(able).select("a", "b")


def _paired(members: DataFrame, *key: str) -> DataFrame:
    """Pairs ``a < b`` of the rows (``key, rep, component``) of one key, of different components."""
    one = members.select(*key, F.col("rep").alias("a"), F.col("component").alias("of_a"))
    two = members.select(*key, F.col("rep").alias("b"), F.col("component").alias("of_b"))
    return one.join(two, list(key)).where("a < b AND of_a <> of_b").select("a", "b")


def _all_pairs(dealt: DataFrame, least: int) -> DataFrame:
    """Pairs ``a < b`` of classes of one ``key`` and different components whose bit maps may share ``least`` percent.

    One end is outside ``main``, the component that has most of the key.
    """
    side = lambda x: dealt.select("key", "main", *(F.col(c).alias(f"{x}_{c}") for c in ("rep", "n", "component", *_MAPS)))
    one, two = side("x"), side("y").where("y_component <> main").drop("main")
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{m}")))) for m in _MAPS), F.lit(0))
    most = F.least(F.col("x_n") - only("x", "y"), F.col("y_n") - only("y", "x"))
    pairs = one.join(two, "key").where(
        (F.col("x_component") != F.col("y_component"))
        & ((F.col("x_component") == F.col("main")) | (F.col("x_rep") < F.col("y_rep")))
        & ((100 + least) * most >= least * (F.col("x_n") + F.col("y_n")))
    )
    return pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _mixed(dealt: DataFrame) -> DataFrame:
    """Of keys with several components: ``key``, ``main``, ``others`` (classes outside it), ``first`` (least class); written."""
    parts = dealt.groupBy("key", "component").agg(F.count("*").alias("k"), F.min("rep").alias("first"))
    every = parts.groupBy("key").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"),
        (F.sum("k") - F.max("k")).alias("others"),
        F.min("first").alias("first"),
    )
    return saved(every.where("others > 0"), "mixed")


def _across(placed: DataFrame, sets: DataFrame, tested: DataFrame, least: int) -> DataFrame:
    """Pairs to compare so that no two classes of one bucket stay apart that share ``least`` percent.

    ``placed``: ``rep``, ``n``, ``component``, ``bands`` and the bit map of each class.
    """
    buckets = placed.select("rep", "component", F.explode("bands").alias("key"))
    mixed = _mixed(buckets)
    whole = placed.select("rep", "n", "component", *_MAPS, F.explode("bands").alias("key"))
    pairs = saved(_all_pairs(saved(whole.join(mixed.where(F.col("others") <= GROUP), "key"), "mixed-members"), least), "pairs")
    links = buckets.join(mixed.where(F.col("others") > GROUP), "key").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    rounds = 0
    while not links.isEmpty():
        group = components(links.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("key"))
        members = saved(group.distinct().join(placed.select("rep", "n", "component"), "rep"), "groups")
        hubs = members.groupBy("key").agg(F.min_by("rep", F.struct("n", "rep")).alias("hub"))
        # A group with others left in the last round gives its pairs.
        large = (F.col("others") > GROUP) & F.lit(rounds < ROUNDS)
        known = saved(_mixed(members).join(hubs, "key"), "hubs")
        rounds += 1
        small = members.select("rep", "key").join(known.where(~large).drop("hub"), "key").join(placed.drop("bands"), "rep")
        pairs = pairs.union(_all_pairs(saved(small, "mixed-members"), least))
        dealt = saved(members.join(known.where(large).select("key", "hub"), "key").where("rep <> hub"), "group-members")
        to_hub = dealt.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        own = dealt.join(sets.select(F.col("id").alias("rep"), F.col("members").alias("own")), "rep")
        against = own.join(sets.select(F.col("id").alias("hub"), F.col("members").alias("hubs")), "hub")
        left = F.explode(F.array_except("own", "hubs")).alias("shingle")
        apart = saved(against.select("key", "rep", "component", left), "apart")
        shared = saved(
            apart.groupBy("key", "shingle")
            .agg(F.count("*").alias("k"), F.min("rep").alias("first"), F.min("component").alias("p"), F.max("component").alias("q"))
            .where("p <> q").select("key", "shingle", "k", "first"),
            "apart-shingles",
        )
        met = saved(apart.join(shared, ["key", "shingle"]), "apart-members")
        few = _paired(met.where(F.col("k") <= PAIRED), "key", "shingle")
        pairs = saved(pairs.union(_hopeful(to_hub.union(few), placed, least)).distinct(), "pairs")
        links = met.where(F.col("k") > PAIRED).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return saved(pairs.join(tested, ["a", "b"], "left_anti"), "edges")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST
) -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` (least id reachable over links), ``kept``.

    Documents are linked where their sets share ``least`` percent or more.
    Nulls, empty texts and texts without words have no set and no link; they are
    kept. Rows keep their number. Rows of one id are one document; if their
    texts differ, a link of any counts for each. A row without an id takes part
    through rows of the same text that have one; without these its component is
    null and it is kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketches = saved(_sketches(rows, shingle), "sketches")
    classes = sketches.where("n > 0 AND _id IS NOT NULL").groupBy("key").agg(F.min("_id").alias("rep"), F.max("_id").alias("last"))
    classes = saved(classes, "classes")
    members = saved(
        sketches.select("_id", "key", "bands").join(classes.select("key", F.col("rep").alias("_id")), ["key", "_id"])
        .select(F.col("_id").alias("rep"), "bands"),
        "members",
    )
    dealt = members.select("rep", F.explode("bands").alias("band"))
    other = F.min(F.col("rep").bitwiseXOR(F.col("band")))
    hubs = saved(
        dealt.groupBy("band").agg(F.min("rep").alias("hub"), other.alias("_other"), F.max("rep").alias("_last"))
        .where("hub < _last").select("band", "hub", F.col("_other").bitwiseXOR(F.col("band")).alias("other")),
        "hubs",
    )
    near = dealt.join(hubs, "band").select("rep", F.explode(F.array("hub", "other")).alias("hub")).where("rep <> hub")
    edges = saved(near.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = saved(_full_sets(rows, ends, shingle), "sets")
    first = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = saved(_confirmed(first, sets, least), "links")
    found = components(links)
    label = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    open_edges = (
        edges.join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
        .where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    )
    more = saved(_confirmed(saved(open_edges, "edges"), sets, least), "links")
    links = links.union(more)
    found = components(links)
    placed = saved(
        sets.withColumn("n", F.size("members")).drop("members").withColumnRenamed("id", "rep").join(members, "rep")
        .join(label("rep"), "rep", "left").withColumn("component", F.coalesce("of_rep", "rep")).drop("of_rep"),
        "placed",
    )
    last = saved(_confirmed(_across(placed, sets, edges, least), sets, least), "links")
    if not last.isEmpty():
        found = components(links.union(last))
    whole = (
        classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .where("rep < last OR component IS NOT NULL")
        .select("key", F.coalesce("component", "rep").alias("component"))
    )
    # Classes of one row that are linked to nothing need no lookup.
    out = sketches.select("_id", "n", "key").join(whole, "key", "left")
    component = F.coalesce("component", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.col("component").isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose document stands for its group.

    Rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, shingle, least).where("NOT kept").select(id_col).where(F.col(id_col).isNotNull())
    return docs.join(gone.distinct().hint("shuffle_hash"), id_col, "left_anti")
