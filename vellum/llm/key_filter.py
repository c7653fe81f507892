"""A filter of hashed keys of fixed size: it may let strange keys pass, never stops a wanted one.

Kernels use it to drop what cannot match before it is handed on; an exact join always follows. The bits are gathered in
words, so at most ``FILTER_BITS / 64`` rows reach the driver and 8 MB every executor, whatever the data; where there are
so many keys that all bits are set, everything passes and the join does the work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str = "k") -> bytes:
    """The bits of all keys of a column."""
    bit = F.expr(f"shiftleft(1L, CAST(pmod({column}, 64) AS INT))")
    rows = keys.select(F.floor(F.pmod(column, F.lit(FILTER_BITS)) / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.tobytes()


def filter_bits(keys: np.ndarray) -> np.ndarray:
    """The bits (uint8) of keys (int64) that are at hand."""
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    slot = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return out


def passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys (int64) pass the bits (uint8)."""
    slot = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
