"""Operator 3: exact dedup with composable polynomial fingerprints.

A text is a sequence of bytes after lower-casing A-Z. Chunks of CHUNK bytes are hashed with two
polynomials modulo primes; `combine` joins the hashes of neighbours by multiplying the left one with
base ** (length of the right one). A text of more than SEGMENT bytes is cut into segments that are rows of their own, hashed in
parallel by any task, and its fingerprint is combined from theirs in the end. Rows with equal fingerprint and length are candidates; their
texts are then compared chunk by chunk: all texts of a group are equal if, for each chunk number, the smallest chunk
equals the largest. That is an aggregate which combines before the shuffle, so a group that holds a third of all rows
is never in one task. A Bloom filter keeps texts that no other equals out of that shuffle; it drops no candidate.

Defined results: a null text is empty, and empty texts are equal to each other. Of each group exactly one row stays: one with
the largest doc_id, and any one of several rows that have it; a row without an id stays only if its whole group has
none. An empty table gives an empty result, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _bloom, _text
from terrane.llm._spark import attach, table

CHUNK = 4096
SEGMENT = 1 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525893)
#: Row k: the weights of byte k of a full chunk; a shorter chunk takes the last rows.
_WEIGHTS = np.array([[pow(b, CHUNK - 1 - k, p) for b, p in zip(BASES, PRIMES, strict=True)] for k in range(CHUNK)], np.float64)

Print = tuple[int, int, int]  # two residues, length
EMPTY: Print = (0, 0, 0)


def chunk_print(data: np.ndarray) -> Print:
    """Of at most CHUNK bytes. Sums stay under 2 ** 53, so doubles hold them exactly."""
    sums = (data.astype(np.float64) + 1.0) @ _WEIGHTS[CHUNK - len(data) :]
    return int(sums[0]) % PRIMES[0], int(sums[1]) % PRIMES[1], len(data)


def combine(left: Print, right: Print) -> Print:
    """The fingerprint of left's bytes followed by right's."""
    n = right[2]
    x, y = ((a * pow(b, n, p) + c) % p for a, b, c, p in zip(left[:2], BASES, right[:2], PRIMES, strict=True))
    return x, y, left[2] + n


def fingerprint(data: np.ndarray) -> Print:
    out = EMPTY
    for k in range(0, len(data), CHUNK):
        part = chunk_print(data[k : k + CHUNK])
        out = combine(out, part) if k else part
    return out


def _rows(batch: pa.RecordBatch):
    data, at = _text.raw(batch.column("text"))
    low = _text.LOWER[data]
    return [low[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _key(found: list[Print], used: int) -> np.ndarray:
    return np.array([(x << 31 | y) & ((1 << used) - 1) for x, y, _ in found], np.int64)


def _prints(used: int, whole: bool):
    """print (only if the whole text is hashed here), n_bytes, text_sha256 of each row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _rows(batch)
        keys = pa.array(_key([fingerprint(x) for x in texts], used)) if whole else pa.nulls(len(texts), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), keys, pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], names=["doc_id", "rid", "print", "n_bytes", "text_sha256"])

    return rows


_PRINTS = "doc_id long, rid long, print long, n_bytes long, text_sha256 string"


def _segment_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(_text.LOWER[np.frombuffer(x.as_py(), np.uint8)]) for x in b.column("data")]
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("number"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=["rid", "number", "x", "y", "n"])


def _combined(used: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [reduce(combine, ((p["x"], p["y"], p["n"]) for p in parts)) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(_key(found, used))], names=["rid", "print"])

    return run


def _segments(long: DataFrame, segment: int, *columns: str) -> DataFrame:
    """rid, columns, number, data: texts cut into segments, which the shuffle deals to all tasks."""
    data, size = F.col("text").cast("binary"), F.octet_length("text")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / segment).cast("int") - 1), lambda k: F.substring(data, k * segment + 1, F.lit(segment)))
    return long.select("rid", *columns, F.posexplode(cut).alias("number", "data")).repartition("rid", "number")


def segment_prints(long: DataFrame, used: int, segment: int) -> DataFrame:
    """rid, print of texts (rid, text): their segments are hashed in parallel and combined in order."""
    parts = _segments(long, segment).mapInArrow(_segment_prints, "rid long, number int, x long, y long, n long")
    # a text has at most 2 GB, so at most 2048 parts
    return parts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("number", "x", "y", "n"))).alias("parts")).mapInArrow(_combined(used), "rid long, print long")


_CHUNKS = "print long, n_bytes long, chunk long, data binary"


def _chunks(used: int, bits: np.ndarray):
    """Chunks of the texts whose fingerprint may be shared."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, lengths, numbers, chunks = [], [], [], []
        texts = _rows(batch)
        keys = _key([fingerprint(x) for x in texts], used)
        for i in np.flatnonzero(_bloom.maybe(bits, keys)).tolist():
            for k in range(0, len(texts[i]), CHUNK):
                prints.append(keys[i])
                lengths.append(len(texts[i]))
                numbers.append(k // CHUNK)
                chunks.append(texts[i][k : k + CHUNK].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.int64()), pa.array(chunks, pa.binary())], names=["print", "n_bytes", "chunk", "data"])

    return rows


def _chunks_of_segments(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, n, number, data in zip(*(b.column(c).to_pylist() for c in ("print", "n_bytes", "number", "data")), strict=True):
                low = _text.LOWER[np.frombuffer(data, np.uint8)]
                at = range(0, len(low), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array([(number * segment + k) // CHUNK for k in at], pa.int64()), pa.array([low[k : k + CHUNK].tobytes() for k in at], pa.binary())], names=["print", "n_bytes", "chunk", "data"])

    return run


def compared(short: DataFrame, long: DataFrame, prints: DataFrame, several: DataFrame, used: int, segment: int) -> DataFrame:
    """print, n_bytes, chunk and the smallest and largest chunk (low, high) of that number, of all texts of the groups in several (print, n_bytes)."""
    chunks = _text.map_text(short, _chunks(used, _bloom.build(several, "print")), _CHUNKS)
    again = prints.where(F.col("n_bytes") > segment).join(several, ["print", "n_bytes"], "left_semi")
    parts = _segments(long.join(again.select("rid", "print", "n_bytes"), "rid"), segment, "print", "n_bytes")
    chunks = chunks.unionByName(parts.mapInArrow(_chunks_of_segments(segment), _CHUNKS))
    return chunks.groupBy("print", "n_bytes", "chunk").agg(F.min("data").alias("low"), F.max("data").alias("high"))


def exact_dedup(docs: DataFrame, bits: int = 62, segment: int = SEGMENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text); bits: of the fingerprint that are used."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid"))
    over = F.coalesce(F.octet_length("text") > segment, F.lit(False))
    short, long = texts.where(~over), texts.where(over)
    large = _text.map_text(long, _prints(bits, False), _PRINTS).drop("print").join(segment_prints(long, bits, segment), "rid")
    prints = table(_text.map_text(short, _prints(bits, True), _PRINTS).unionByName(large))
    keys = ["print", "n_bytes"]
    stays = F.max(F.struct("doc_id", "rid")).alias("keep")
    groups = table(prints.groupBy(*keys).agg(F.count("*").alias("group_size"), stays))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    several = groups.where("group_size > 1").select(*keys)
    unequal = table(compared(short, long, prints, several, bits, segment).where("low <> high").select(*keys).distinct())
    if unequal.limit(1).count():  # texts that differ share a fingerprint: told apart by their digests
        prints = prints.join(unequal.withColumn("split", F.lit(True)), keys, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit(""))).drop("split")
        prints, keys = table(prints), [*keys, "part"]
        groups = table(prints.groupBy(*keys).agg(F.count("*").alias("group_size"), stays))
    out = attach(prints, groups, keys, "group_size", total, "inner")
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")
