"""A bit map of fixed size that tells which hashes a table of any size can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Which hashes (column ``hash``, longs), modulo BITS, there are. 8 MB on the driver, however many there are."""
    place = F.pmod("hash", F.lit(BITS))
    words = (
        hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(hash, {BITS}) & 63 AS int))").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(b)").alias("b"))
        .toArrow()
    )
    bits = np.zeros(BITS // 64, dtype=np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash (unsigned) whether the table may hold it."""
    place = hashes % np.uint64(BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
