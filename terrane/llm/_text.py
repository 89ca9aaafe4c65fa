"""Vectorised reading of text columns: words, word hashes and shingles of whole Arrow slices.

A slice of rows is handled as one byte buffer. Words are found with a lookup table over bytes and hashed
with a polynomial whose prefix sums are taken blockwise, so a text of any length needs memory in
proportion to its bytes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SLICE_BYTES = 2 << 20
_BLOCK = 1 << 17

#: A-Z become a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = False

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_A = 0xD6E8FEB86659FD93
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, _U)
    out[1:] = _U(base & _M)
    return np.cumprod(out, dtype=_U)


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_POW, _INV = powers(_P, _BLOCK * 2), powers(_PINV, _BLOCK)


@dataclass
class Words:
    """Words of a slice: word k of row r is at first[r] + k; start and end are byte positions in low."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(low: np.ndarray, rows: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not in `between`; rows separate runs too."""
    inside = ~between[low]
    edge = rows[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes[:-1] &= ~inside[1:]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out, i, n = np.empty(len(start), _U), 0, len(start)
    while i < n:
        a = start[i]
        if end[i] - a > _BLOCK:
            out[i] = _long_hash(low[a : end[i]])
            i += 1
            continue
        j = int(np.searchsorted(end, a + _BLOCK, side="right"))
        b = end[j - 1]
        sums = np.zeros(b - a + 1, _U)
        np.cumsum(_TABLE[low[a:b]] * _POW[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _INV[np.minimum(s, _BLOCK - 1)]
        i = j
    return mix(out + (end - start).astype(_U) * _U(_A))


def _long_hash(data: np.ndarray) -> int:
    total, shift, step = 0, 1, pow(_P, _BLOCK, 1 << 64)
    for k in range(0, len(data), _BLOCK):
        part = data[k : k + _BLOCK]
        total = (total + int((_TABLE[part] * _POW[: len(part)]).sum(dtype=_U)) * shift) & _M
        shift = shift * step & _M
    return total


def words(texts: pa.Array, between: np.ndarray = SPACE) -> Words:
    data, rows = raw(texts)
    low = LOWER[data]
    start, end = spans(low, rows, between)
    return Words(low, start, end, np.searchsorted(start, rows), hash_spans(low, start, end))


class Sequences:
    """Hashes of word sequences given by ranges of positions, from prefix sums over all words of a slice."""

    def __init__(self, hashes: np.ndarray, seed: int):
        self.seed, self.sums = _U(seed), np.zeros(len(hashes) + 1, _U)
        np.cumsum(mix(hashes ^ self.seed) * odd_powers(len(hashes)), out=self.sums[1:])
        self.inverse = odd_powers(len(hashes) + 1, True)

    def plain(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sum of word k times the k-th power: composable, not yet mixed."""
        return (self.sums[hi] - self.sums[lo]) * self.inverse[lo]

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(self.plain(lo, hi) + (hi - lo).astype(_U) + self.seed)

    def without(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the ranges with the word at position `at` left out; equal to `hash` of that shorter sequence."""
        rest = self.plain(lo, at) + self.plain(at + 1, hi) * odd_powers(int((at - lo).max(initial=0)) + 1)[at - lo]
        return mix(rest + (hi - lo - 1).astype(_U) + self.seed)


def sequence_hash(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the word sequence of each row, 0 words included."""
    return Sequences(hashes, seed).hash(first[:-1], first[1:])


_cache: dict[bool, np.ndarray] = {}


def odd_powers(n: int, inverse: bool = False) -> np.ndarray:
    if inverse not in _cache or len(_cache[inverse]) < n:
        _cache[inverse] = powers(pow(_A, -1, 1 << 64) if inverse else _A, max(n, 1 << 18))
    return _cache[inverse][:n]


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all rows in order, and how many each row has.

    A row of 1 to n - 1 words has one shingle, of all its words; a row of none has no shingle.
    """
    counts, h = w.counts, w.hash
    m = len(h)
    value, keep = np.zeros(m, _U), np.zeros(m, bool)
    if m >= n:
        total = np.zeros(m - n + 1, _U)
        for k in range(n):
            total = total * _U(_A) + h[k : m - n + 1 + k]
        value[: m - n + 1] = mix(total)
        last = np.repeat(w.first[1:], counts)
        keep = np.arange(m) + n <= last
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        total = 0
        for x in h[w.first[r] : w.first[r + 1]].tolist():
            total = (total * _A + x) & _M
        value[w.first[r]], keep[w.first[r]] = mix(np.array([total ^ int(counts[r])], _U))[0], True
    return value[keep], np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one longer row."""
    _, rows = raw(texts)
    lo, n = 0, len(rows) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == _U else x.astype(np.int64)


def wide(one: np.ndarray, two: np.ndarray) -> pa.Array:
    """128-bit keys of two 64-bit hashes."""
    both = np.ascontiguousarray(np.stack([one.view(_U), two.view(_U)], 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(both)]).cast(pa.binary())


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Applies fn to slices of df, which has a string column `text`; a null text is empty."""
    from terrane.llm._spark import ship

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(batch.schema.get_field_index("text")), limit):
                out = fn(batch.slice(lo, hi - lo))
                if out is not None and out.num_rows:
                    yield out

    return df.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema)
