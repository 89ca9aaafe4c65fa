"""Operator 4: substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a byte covers the GEAR bytes up to it. A chunk ends where this hash is the largest among
RADIUS bytes on either side, so boundaries depend on nearby bytes only and an insertion moves no boundary beyond
them; chunks are longer than RADIUS, about twice that on average, and those over LONGEST bytes are cut every
LONGEST bytes from their start. Chunks are deduplicated by digest: a chunk is repeated if different documents
have its digest; a Bloom filter keeps most other chunks out of the join that looks
them up. Neighbouring repeated chunks of a document join to spans, and spans of at least
MIN_WORDS words are reported; one chunk has about a fifth of those words, so digests of 64 bits that agree by chance make no span.
Only periodic bytes have no such maxima; LONGEST is counted from the boundary before them, which an
insertion elsewhere does not move. The partial chunks at the edges of a repeated passage differ, so about ten words
of it at either end can be missing from its span.

Defined results: a null text is empty and has no chunk. Rows of the same doc_id, or of none, are documents
of their own if their texts differ, told apart by a hash of both (the row key); rows alike in doc_id and text are
one document. A null doc_id comes before all others, and of rows with the same id the smallest key. Documents without a repeated passage give no row.
An empty table gives an empty result, other columns are ignored, whatever their names. A very long text is cut in one task, in memory in proportion to its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import _bloom, _text
from terrane.llm._spark import attach, row_key, ship, table

GEAR = 8
RADIUS = 12
LONGEST = 512
MIN_WORDS = 25
_PAD = 32
_TABLE = (_text.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_NO_ID = -(1 << 63)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash h = 2 h + table[byte] of the last GEAR bytes, for all places at once by doubling the width."""
    h, width = _TABLE[data], 1
    while width < GEAR:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, width * 2
    return _spread(h)


def _spread(h: np.ndarray) -> np.ndarray:
    """Lets high and low bits take part alike when hashes are compared."""
    return (h * np.uint32(0x9E3779B1)) ^ (h >> np.uint32(7))


def _highest_before(h: np.ndarray, radius: int) -> np.ndarray:
    """The largest of the `radius` values before each place."""
    out, width = np.zeros_like(h), 1
    out[1:] = h[:-1]
    while width < radius:
        step = min(width, radius - width)
        wider = out.copy()
        np.maximum(out[step:], out[:-step], out=wider[step:])
        out, width = wider, width + step
    return out


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all rows; rows are kept apart by zero bytes while hashing."""
    n = len(at) - 1
    shift = _PAD * np.repeat(np.arange(1, n + 1), np.diff(at))
    place = np.arange(len(data)) + shift
    padded = np.zeros(len(data) + _PAD * (n + 1), np.uint8)
    padded[place] = data
    h = gear(padded)
    peak = (h > _highest_before(h, RADIUS)) & (h >= _highest_before(h[::-1], RADIUS)[::-1])
    ends = np.flatnonzero(peak[place]) + 1
    edges = np.unique(np.concatenate([at, ends]))
    start, end = edges[:-1], edges[1:]
    long = np.flatnonzero(end - start > LONGEST)
    if len(long):
        more = np.concatenate([np.arange(a + LONGEST, b, LONGEST) for a, b in zip(start[long], end[long], strict=True)])
        edges = np.unique(np.concatenate([edges, more]))
        start, end = edges[:-1], edges[1:]
    return start, end


def _chunk_rows(batch: pa.RecordBatch, bits: np.ndarray | None = None) -> pa.RecordBatch:
    """All chunks, or those whose digest may be among the wanted ones."""
    data, at = _text.raw(batch.column("text"))
    start, end = cuts(data, at)
    row = np.searchsorted(at, start, side="right") - 1
    first, _ = _text.spans(data, at, _text.SPACE)
    words = np.searchsorted(first, end) - np.searchsorted(first, start)
    number = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
    digest = _text.signed(_text.hash_spans(data, start, end))
    k = np.arange(len(start)) if bits is None else np.flatnonzero(_bloom.maybe(bits, digest))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(row[k])), batch.column("row").take(pa.array(row[k])), pa.array(digest[k]), pa.array(number[k].astype(np.int32)), pa.array((start - at[row])[k].astype(np.int64)), pa.array((end - start)[k].astype(np.int32)), pa.array(words[k].astype(np.int32))],
        names=["doc_id", "row", "digest", "number", "start", "size", "words"],
    )


def _row() -> Column:
    """Tells rows of the same doc_id apart."""
    return F.xxhash64(row_key())


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_byte, end_byte, n_chunks, n_words, first_doc_id, row, first_row of each repeated passage; first_doc_id is the smallest id that has one of its chunks, row and first_row tell rows of these ids apart."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text", _row().alias("row"))
    schema = "doc_id long, row long, digest long, number int, start long, size int, words int"
    counted = _text.map_text(texts, _chunk_rows, schema).groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("w"))
    shared = table(counted.where("lo <> hi").select("digest", "first_doc", "w"))
    total = shared.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    bits = _bloom.build(shared, "digest")
    chunks = _text.map_text(texts, lambda batch: _chunk_rows(batch, bits), schema)
    found = table(attach(chunks, shared, ["digest"], "w", total, "inner").select("doc_id", "row", "digest", "number", "start", "size", "words", "first_doc", "w"))
    # of rows with the first id, the one with the smallest key is first
    firsts = table(found.where("doc_id = first_doc").groupBy("digest").agg(F.min("row").alias("first_row"), F.first("w").alias("w")))
    found = attach(found.drop("w"), firsts, ["digest"], "w", total, "inner").select("doc_id", "row", "number", "start", "size", "words", "first_doc", "first_row")
    order = Window.partitionBy("doc_id", "row").orderBy("number")
    runs = found.dropDuplicates(["doc_id", "row", "number"]).withColumn("run", F.col("number") - F.row_number().over(order))
    spans = runs.groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("size")).alias("end_byte"), F.count("*").alias("n_chunks"), F.sum("words").cast("long").alias("n_words"), F.min(F.struct("first_doc", "first_row")).alias("first")
    ).withColumns({"first_doc_id": F.col("first.first_doc"), "first_row": F.col("first.first_row")})
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return spans.where(F.col("n_words") >= min_words).select(real("doc_id"), "start_byte", "end_byte", "n_chunks", "n_words", real("first_doc_id"), "row", "first_row")


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the passages in spans (of repeated_spans) whose first document is another one. Columns stay; a text cut inside a character loses that character."""
    ship(docs.sparkSession)
    name = f"spans_{uuid.uuid4().hex}"  # like no column of docs
    gone = spans.where("row <> first_row").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias(name))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("of"), _row().alias("row"))
    joined = keyed.join(gone, keyed["of"].eqNullSafe(gone["doc_id"]) & (keyed["row"] == gone["row"]), "left").select("doc.*", name)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                if spans and text:
                    raw, kept, at = text.encode(), [], 0
                    for s in spans:
                        kept.append(raw[at : s["start_byte"]])
                        at = s["end_byte"]
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == k else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).drop_columns([name])

    return joined.mapInArrow(cut, docs.schema)
