"""Operator 9: line dedup with a deletion-neighbourhood join.

Lines are the parts of a text between newlines; they are compared as sequences of lower-cased words, and the
edit distance counts words. Two lines are copies if their distance is at most the bound of the shorter one: one edit for
every WORDS_PER_EDIT words, and EDITS at most, so lines of fewer words are copies only when they are equal. Of copies the
earliest line stays: going through all lines by doc_id, line number and row key, a line goes if it is a copy of an
earlier line that has stayed. A line near one that has gone, but near none that stayed, stays.

Two lines one edit apart share a variant with one word deleted. Each line emits its variants as hashed keys
twice: with the place of the deletion, where all lines of a key are one substitution apart, and without, where
they meet the whole lines that are one word shorter. Which lines stay is settled in rounds over these keys: a line without an
undecided or staying earlier partner stays, one with a partner that stays goes, and only the rest takes part in the next round. Keys
carry minima, so a key shared by any number of lines makes no pairs; a line goes only after a word by word
comparison with the partner that stays. A round settles at least the earliest undecided line of every group, so there are as many
rounds as the longest run of lines that each wait for the one before, two or three on most texts.

Lines can only have a partner if some other line shares their first or last half, so those keys are counted
first and lines alone in both emit no variants; a Bloom filter tells which, and lets some others pass, so nothing is lost.

Defined results: a null text is empty and stays null; lines without words always stay. Rows of the
same doc_id, or of none, are documents of their own if their texts differ, told apart by a hash of both (the row
key); rows alike in doc_id and text are one document and keep the same lines. A null doc_id comes before all others. An
empty table gives an empty result, and other columns are kept as they are, whatever their names, but for `n_chars`, which is
set anew where there is one. A very long text or line is read by one task. Lines are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from terrane.llm import _bloom, _text
from terrane.llm._spark import attach, discard, row_key, ship, table

EDITS = 1
WORDS_PER_EDIT = 8
_SEED = 0x51ED


def bound(n: int) -> int:
    """Edits that still make a copy, for a pair whose shorter line has n words."""
    return min(n // WORDS_PER_EDIT, EDITS)


def line_starts(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every line of all rows, and how many lines each row has."""
    new = np.flatnonzero(low == 10)
    owner = np.searchsorted(at, new, side="right") - 1
    return np.sort(np.concatenate([at[:-1], new + 1])), np.bincount(owner, minlength=len(at) - 1) + 1


def _lines(texts: pa.Array):
    """Words of the slice; of each line with words: its row, its number in the row, and its word positions lo, hi."""
    w = _text.words(texts)
    _, at = _text.raw(texts)
    starts, counts = line_starts(w.low, at)
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    bounds = np.append(np.searchsorted(w.start, starts), len(w.start))
    lo, hi = bounds[:-1], bounds[1:]
    ok = hi > lo
    return w, row[ok], number[ok], lo[ok], hi[ok]


def _identity(w: _text.Words, lo: np.ndarray, hi: np.ndarray) -> tuple[_text.Sequences, pa.Array]:
    one = _text.Sequences(w.hash, _SEED)
    return one, _text.wide(one.hash(lo, hi), _text.Sequences(w.hash, _SEED + 1).hash(lo, hi))


def _halves(s: _text.Sequences, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the first and last (n - 1) // 2 words, and of as many as a line that is one word shorter has; which of them are used."""
    n = hi - lo
    for less in (0, 1):
        h = np.maximum(n - 1 - less, 0) // 2
        use = (n - less >= WORDS_PER_EDIT) & ((less == 0) | (h != (n - 1) // 2))
        yield s.hash(lo, lo + h), use
        yield ~s.hash(hi - h, hi), use


def _line_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    w, row, number, lo, hi = _lines(batch.column("text"))
    s, line = _identity(w, lo, hi)
    keys = [pa.array(_text.signed(key), mask=~use) for key, use in _halves(s, lo, hi)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(number), line, *keys], names=["doc_id", "row", "line_no", "line", "k0", "k1", "k2", "k3"])


_LINE_ROWS = "doc_id long, row binary, line_no long, line binary, k0 long, k1 long, k2 long, k3 long"


def _candidates(bits: np.ndarray):
    """Lines that may share a half with another one, with the hashes of their words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, row, number, lo, hi = _lines(batch.column("text"))
        ok = np.flatnonzero(hi - lo >= WORDS_PER_EDIT)
        lo, hi = lo[ok], hi[ok]
        s = _text.Sequences(w.hash, _SEED)
        hit = np.zeros(len(ok), bool)
        for key, use in _halves(s, lo, hi):
            hit |= use & _bloom.maybe(bits, key)
        lo, hi = lo[hit], hi[hit]
        words = [w.hash[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
        return pa.RecordBatch.from_arrays([_identity(w, lo, hi)[1], pa.array(words, pa.binary())], names=["line", "words"])

    return rows


def _variants(bits: np.ndarray | None = None):
    """Keys of each line: whole (kind 0), one deleted at a place (1), one deleted anywhere (2; meets kind 0). bits: which keys are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                words = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
                n = np.array([len(x) for x in words])
                hi = np.cumsum(n)
                lo = hi - n
                s = _text.Sequences(np.concatenate(words), _SEED)
                owner = np.repeat(np.arange(len(n)), n)
                at = np.arange(hi[-1])
                gone = s.without(lo[owner], hi[owner], at)
                placed = _text.mix(gone + (at - lo[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                # a line of the least length has no shorter copy
                shorter = (n > WORDS_PER_EDIT)[owner]
                rows = np.concatenate([np.arange(len(n)), owner, owner[shorter]])
                key = np.concatenate([s.hash(lo, hi), placed, gone[shorter]])
                kind = np.repeat([0, 1, 2], [len(n), len(at), int(shorter.sum())])
                if bits is not None:
                    use = _bloom.maybe(bits, key)
                    rows, key, kind = rows[use], key[use], kind[use]
                order = np.lexsort((kind, key, rows))
                rows, key, kind = rows[order], key[order], kind[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
                ord_ = np.asarray(part.column("ord"))
                yield pa.RecordBatch.from_arrays([pa.array(ord_[rows[new]]), pa.array(_text.signed(key[new])), pa.array(kind[new])], names=["ord", "key", "kind"])

    return run


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one inserted, deleted or substituted word turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    if not len(unlike):
        return True
    k = int(unlike[0])
    if len(a) == len(b):
        return len(unlike) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return bool((longer[k + 1 :] == shorter[k:]).all())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [within_one(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("words").to_pylist(), b.column("partner_words").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array(good, pa.bool_())], names=["ord", "good"])


def _place() -> Column:
    return F.struct("doc_id", "line_no", "row")


def _partners(keys: DataFrame) -> DataFrame:
    """The earliest line of each key, by kind."""
    of = [F.min(F.when(F.col("kind") == k, F.col("ord"))).alias(n) for k, n in enumerate(("own", "placed", "gone"))]
    return keys.groupBy("key").agg(*of, F.count("*").alias("w"))


def _earlier(keys: DataFrame, partners: DataFrame, total: int) -> DataFrame:
    """The earliest partner of each line that has an earlier one; total: rows of which the partners were made."""
    partner = F.when(F.col("kind") == 0, F.col("gone")).when(F.col("kind") == 1, F.col("placed")).otherwise(F.col("own"))
    return attach(keys, partners, ["key"], "w", total, "inner").select("ord", partner.alias("partner")).where("partner < ord").groupBy("ord").agg(F.min("partner").alias("partner"))


def _near(texts: DataFrame, every: DataFrame, places: DataFrame) -> DataFrame:
    """Lines (line) that go because an earlier line that stays is one edit away; every: all lines, places: the first place of each."""
    halves = every.select("line", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    shared = table(halves.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("key"))
    found = _text.map_text(texts, _candidates(_bloom.build(shared, "key")), "line binary, words binary").groupBy("line").agg(F.first("words").alias("words"))
    # numbers in order of place: of the ranges, then of places in them
    ranges = found.join(places, "line").repartitionByRange("place").sortWithinPartitions("place")
    lines = table(ranges.select("line", "words", F.monotonically_increasing_id().alias("ord")))
    schema = "ord long, key long, kind long"
    keys = lines.mapInArrow(_variants(), schema).groupBy("key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo <> hi")
    keys = table(keys.select("key"))
    undecided = table(lines.mapInArrow(_variants(_bloom.build(keys, "key")), schema))
    staying = undecided.limit(0)
    discard(shared, keys)
    gone, n, m = [], undecided.count(), 0
    while n:
        waits = table(_earlier(undecided, _partners(undecided.unionByName(staying)), n + m).select("ord"))
        waiting = undecided.join(waits, "ord", "left_semi")
        now = table(staying.unionByName(undecided.join(waits, "ord", "left_anti")))
        m = now.count()
        pairs = _earlier(waiting, _partners(now), m).join(lines.select("ord", "words"), "ord").join(lines.select(F.col("ord").alias("partner"), F.col("words").alias("partner_words")), "partner")
        out = table(pairs.select("ord", "words", "partner_words").mapInArrow(_compared, "ord long, good boolean"))
        # a line that is unlike its partner met it by a collision of hashes, and stays
        rest = table(waiting.join(out, "ord", "left_anti"))
        discard(waits, undecided, *([staying] if gone else []))
        gone.append(out)
        undecided, staying, n = rest, now, rest.count()
    if not gone:
        return lines.select("line").limit(0)
    for more in gone[1:]:
        gone[0] = gone[0].unionByName(more)
    return lines.join(gone[0].where("good"), "ord", "left_semi").select("line")


def removals(docs: DataFrame) -> DataFrame:
    """row (the row key), removed: the sorted line numbers that go, n: rows with this key; for each document that loses a line."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    lines = table(_text.map_text(texts, _line_rows, _LINE_ROWS))
    places = table(lines.groupBy("line").agg(F.min(_place()).alias("place"), F.count("*").alias("copies")))
    near = _near(texts, lines, places.select("line", "place")).withColumn("near", F.lit(True))
    marked = places.join(near, "line", "left").where("near or copies > 1").select("line", F.col("place.row").alias("first_row"), F.col("place.line_no").alias("first_no"), "copies", F.coalesce("near", F.lit(False)).alias("near"))
    marked = table(marked)
    gone = attach(lines.select("row", "line_no", "line"), marked, ["line"], "copies", lines.count(), "inner")
    gone = gone.where(F.col("near") | (F.col("row") != F.col("first_row")) | (F.col("line_no") != F.col("first_no")))
    gone = gone.groupBy("row").agg(F.collect_set("line_no").alias("removed"), F.count("*").alias("n"))
    return gone.select("row", F.array_sort("removed").alias("removed"), (F.col("n") / F.size("removed")).cast("long").alias("n"))


def line_dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with repeated lines left out of `text`; with counts also n_lines, n_removed (names that docs has already are replaced)."""
    ship(docs.sparkSession)
    removed = table(removals(docs))
    bits = _bloom.build(removed.select(F.xxhash64("row").alias("hash")), "hash")

    @pandas_udf(BooleanType())
    def loses(key: pd.Series) -> pd.Series:
        return pd.Series(_bloom.maybe(bits, key.to_numpy(np.int64)))

    # only documents that may lose a line take part in the join; all columns travel in one, so no name of theirs matters
    whole = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).withColumn("hit", loses(F.xxhash64("row")))
    rest = whole.where("not hit").select("doc", F.lit(None).cast("array<long>").alias("removed"))
    hit = attach(whole.where("hit").select("doc", "row"), removed, ["row"], "n", docs.count()).select("doc", "removed")
    both = rest.unionByName(hit)
    text = F.col("doc.text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    new = {"text": F.when(F.col("removed").isNull(), text).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed").isNull(), F.col("doc.n_chars")).otherwise(F.length(kept).cast("long"))
    if counts:
        new["n_lines"] = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
        new["n_removed"] = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return both.select(*[new.pop(c).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns], *[v.alias(k) for k, v in new.items()])
