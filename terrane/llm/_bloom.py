"""A Bloom filter over a column of hashes: made in the cluster, sized by the number of keys, sent to tasks, and without misses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_KEY = 24
PROBES = 3
#: The filter's size in bits, as a power of two: from 4 kB up to 16 MB, which it never exceeds. With more keys than fit, more others pass.
LEAST, MOST = 15, 27
_BUCKET = 1 << 15


def build(df: DataFrame, column: str, keys: int | None = None) -> np.ndarray:
    """The filter's bytes. The column's values should be 64-bit hashes; keys: how many there are, counted if not given."""
    n = df.count() if keys is None else keys
    mask = (1 << min(max(int(n * PER_KEY).bit_length(), LEAST), MOST)) - 1
    first, step = F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseOR(1)
    at = df.select(F.explode(F.array(*[(first + step * k).bitwiseAND(mask) for k in range(PROBES)])).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits")).collect()
    out = np.zeros(((mask + 1) // _BUCKET, _BUCKET // 8), np.uint8)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys
    mask = np.uint64(len(bits) * 8 - 1)
    first, step = keys & mask, (keys >> np.uint64(32)) | np.uint64(1)
    out = np.ones(len(keys), bool)
    for k in range(PROBES):
        at = (first + step * np.uint64(k)) & mask
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out
