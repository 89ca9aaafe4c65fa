"""Operator 5: n-gram Jaccard join with a MinHash LSH forest.

Texts are sets of five-word shingles of lower-cased words. Each text has a label of DEPTH minimum hashes in each of
TREES trees; in a tree, texts whose labels begin alike are below one node of its prefix trie. The join starts at
full depth, where texts with equal labels meet, and verifies all new pairs there exactly. From the links found so far it
estimates the recall: a link of similarity s is met at depth d with a probability that is known, so dividing by it says how
many links there are. While the estimate is below the target, prefixes are shortened by one and the trie nodes that branch at that
depth are verified; nodes with one child have nothing new. Shortening ends at the latest where the
probability for a pair at the threshold itself reaches the target (`floor_depth`), whatever has been found.

A trie node of any size is dealt to blocks of about BLOCK shingles, and every pair of blocks goes to a task of its own. There, a pair of
texts is looked at only in the first tree, and at the greatest depth, at which it meets, so each is verified once.
Products of shingle incidence matrices give the intersections; only counts of links and a spanning forest leave the
task, never the pairs. Only texts that share a prefix of the shortest depth with another one are read again.

Texts with the same word sequence are collapsed first and count as linked to each other. The result has a row
for each document: the smallest doc_id of its connected class, and how many other documents are linked to it.

Defined results: a null text is empty; texts without words are copies of each other and have no other link; a
text of one to four words has one shingle, of all its words. Rows that repeat a doc_id are documents of their
own. A null doc_id is never a class's id unless all ids in the class are null. An empty table gives an empty
result, other columns are ignored and may have any name. A text of any length is one set of shingles in one task.
Word sequences are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from terrane.llm import _bloom, _text
from terrane.llm._spark import attach, connected, discard, row_key, ship, table

THRESHOLD = 0.8
RECALL = 0.9999
TREES = 24
DEPTH = 7
BLOCK = 1 << 18
#: Added to a text's shingles in a block's size, so blocks of short texts are bounded too.
EACH = 256
TILE = 256
COLUMNS = 8192
FEW = 48
BINS = 20
SEED = 5


def recall(depth: int, similarity: float, trees: int = TREES) -> float:
    """Probability that two sets of this similarity share a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(similarity: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The greatest depth at which even pairs at the threshold are met with the target's probability."""
    while depth > 1 and recall(depth, similarity, trees) < target:
        depth -= 1
    if recall(depth, similarity, trees) < target:
        raise ValueError(f"{trees} trees can't reach a recall of {target} at {similarity}")
    return depth


def estimated_recall(found: np.ndarray, depth: int, threshold: float, trees: int = TREES) -> float:
    """Share of all links that depth has met; found: counts of links by similarity, in equal steps from the threshold to 1."""
    low = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    return float(found.sum() / (found / recall(depth, low, trees)).sum()) if found.sum() else 0.0


def signatures(values: np.ndarray, counts: np.ndarray, trees: int, full: int, depth: int, seed: int) -> np.ndarray:
    """The first `depth` minimum hashes of each tree's label (rows with shingles, trees, depth); labels have `full`."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 32, (2, trees * full), np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, trees * full, np.uint32)
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    filled = counts > 0
    starts = (np.cumsum(counts) - counts)[filled]
    out = np.empty((trees, depth, len(starts)), np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    for t in range(trees if len(starts) else 0):
        for d in range(depth):
            k = t * full + d
            np.multiply(low, odd[0, k], out=x)
            np.multiply(high, odd[1, k], out=y)
            x += y
            x += add[k]
            x ^= x >> np.uint32(15)
            np.minimum.reduceat(x, starts, out=out[t, d])
    return out.transpose(2, 0, 1)


def prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the tree's number and the first `depth` minimum hashes (rows, trees)."""
    h = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=np.uint64), labels.shape[:2])
    for k in range(depth):
        h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, k])
    return h


def _nodes(w: _text.Words, seed: int) -> pa.Array:
    return _text.wide(*(_text.sequence_hash(w.hash, w.first, seed * 2 + k) for k in (0, 1)))


def _first_rows(seed: int, depth: int, trees: int, full: int):
    """Node and shortest prefixes of each row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _text.words(batch.column("text"))
        values, counts = _text.shingles(w)
        keys: list[list[int] | None] = [None] * len(counts)
        found = _text.signed(prefixes(signatures(values, counts, trees, full, depth, seed), depth))
        for r, ks in zip(np.flatnonzero(counts > 0).tolist(), found, strict=True):
            keys[r] = ks
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), _nodes(w, seed), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "keys"])

    return rows


def _some(bits: np.ndarray):
    """Nodes of which some prefix may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            flat = np.asarray(keys.flatten())
            hit = np.zeros(b.num_rows, bool)
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(keys.offsets)))
            hit[owner[_bloom.maybe(bits, flat)]] = True
            yield b.select(["node", "copies", "pick"]).filter(pa.array(hit))

    return run


def _set_rows(seed: int, trees: int, full: int, bits: np.ndarray):
    """Shingles and labels of the rows that may have been picked."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(_bloom.maybe(bits, np.asarray(batch.column("hash")))))
        if not batch.num_rows:
            return None
        w = _text.words(batch.column("text"))
        values, counts = _text.shingles(w)
        sets = [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
        labels: list[bytes | None] = [None] * len(counts)
        for r, x in zip(np.flatnonzero(counts > 0).tolist(), signatures(values, counts, trees, full, full, seed), strict=True):
            labels[r] = x.tobytes()
        return pa.RecordBatch.from_arrays([_nodes(w, seed), batch.column("row"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(labels, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["node", "pick", "shingles", "labels", "size"])

    return rows


def _labels(column: pa.Array, trees: int) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint32).reshape(len(blobs), trees, -1)


def _members(depth: int, trees: int):
    """A row for each text and tree: the trie node of this depth and its child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                labels = _labels(b.column("labels"), trees)
                key, child = prefixes(labels, depth), prefixes(labels, min(depth + 1, labels.shape[2]))
                owner = pa.array(np.repeat(np.arange(b.num_rows), trees))
                tree = np.tile(np.arange(trees, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("node").take(owner), b.column("size").take(owner), pa.array(tree), pa.array(_text.signed(key.ravel())), pa.array(_text.signed(child.ravel()))], names=["node", "size", "tree", "key", "child"])

    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    every = left + right
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values, column = np.unique(np.concatenate(every), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(left)
    out = np.zeros((n, len(right)), np.float32)
    for c in range(0, len(values), COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(every), min(COLUMNS, len(values) - c)), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        out += m[:n] @ m[n:].T
    return out


def _similar(sets: list[np.ndarray], wanted: np.ndarray, rows: slice, cols: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the wanted pairs (a matrix over rows x cols), those that are linked, and their similarity."""
    r, c = np.nonzero(wanted)
    size = np.array([len(x) for x in sets], float)
    if len(r) <= FEW:
        both = np.array([len(np.intersect1d(sets[rows.start + i], sets[cols.start + j], assume_unique=True)) for i, j in zip(r, c, strict=True)], float)
    else:
        used_r, used_c = np.unique(r), np.unique(c)
        found = common([sets[rows.start + i] for i in used_r], [sets[cols.start + j] for j in used_c])
        both = found[np.searchsorted(used_r, r), np.searchsorted(used_c, c)].astype(float)
    total = size[rows][r] + size[cols][c] - both
    # the same whole numbers on both sides of the comparison, so ties at the threshold are kept
    ok = both >= threshold * total - 1e-9 * (total + both)
    return r[ok], c[ok], (both / np.maximum(total, 1))[ok]


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each index of a symmetric matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0:
            seen = np.zeros(n, bool)
            front = np.zeros(n, bool)
            front[k] = True
            while front.any():
                seen |= front
                front = linked[front].any(0) & ~seen
            root[seen] = k
    return root


def _verify(part: dict, i: int, j: int, tree: int, depth: int, threshold: float) -> pa.RecordBatch:
    """Links of the texts of two blocks (or of one) of a trie node: only pairs that meet here first."""
    sets, block, labels = part["sets"], part["block"], part["labels"]
    n = len(sets)
    here = prefixes(labels, depth)
    deeper = prefixes(labels, depth + 1) if depth < labels.shape[2] else None
    linked, bins = np.zeros((n, n), bool), np.zeros(BINS, np.int64)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            rows, cols = slice(a, min(a + TILE, n)), slice(b, min(b + TILE, n))
            wanted = here[rows, tree, None] == here[None, cols, tree]
            wanted &= np.arange(rows.start, rows.stop)[:, None] < np.arange(cols.start, cols.stop)
            if i != j:
                wanted &= block[rows, None] != block[None, cols]
            for t in range(len(here[0]) if wanted.any() else 0):
                if t < tree:
                    wanted &= here[rows, t, None] != here[None, cols, t]
                if deeper is not None:
                    wanted &= deeper[rows, t, None] != deeper[None, cols, t]
            if wanted.any():
                r, c, s = _similar(sets, wanted, rows, cols, threshold)
                linked[r + a, c + b] = linked[c + b, r + a] = True
                bins += np.bincount(np.clip(((s - threshold) / max(1 - threshold, 1e-9) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
    any_ = np.flatnonzero(linked.any(1))
    node = part["node"]
    filled = np.flatnonzero(bins)
    none = lambda m, kind: pa.nulls(m, kind)
    take = lambda at: pa.array([node[k] for k in at], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([take(any_), none(len(filled), pa.binary())]),
            pa.concat_arrays([take(_roots(linked)[any_]), none(len(filled), pa.binary())]),
            pa.array(np.concatenate([(linked @ part["copies"])[any_], np.zeros(len(filled), np.int64)])),
            pa.concat_arrays([none(len(any_), pa.int32()), pa.array(filled.astype(np.int32))]),
            pa.array(np.concatenate([np.zeros(len(any_), np.int64), bins[filled]])),
        ],
        names=["node", "near", "links", "bin", "pairs"],
    )


_FOUND = "node binary, near binary, links long, bin int, pairs long"


def _verified(depth: int, trees: int, threshold: float):
    """Takes rows sorted by (key, i, j); at most the two blocks of one pair are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, copies, block, shingles, labels = zip(*held, strict=True)
                part = {"node": node, "copies": np.array(copies, np.int64), "block": np.array(block), "sets": [np.frombuffer(x, np.uint64) for x in shingles], "labels": np.frombuffer(b"".join(labels), np.uint32).reshape(len(node), trees, -1)}
                yield _verify(part, key[1], key[2], key[3], depth, threshold)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "tree", "node", "copies", "block", "shingles", "labels")), strict=True):
                if row[:4] != key:
                    yield from close()
                    key, held = row[:4], []
                held.append(row[4:])
        yield from close()

    return run


def _level(sets: DataFrame, depth: int, full: int, trees: int, block: int, threshold: float) -> DataFrame:
    """What `_verify` finds in the trie nodes of this depth, in all trees."""
    members = sets.mapInArrow(_members(depth, trees), "node binary, size long, tree int, key long, child long")
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    nodes = members.groupBy("key", "tree").agg(F.count("*").alias("w"), F.sum(F.col("size") + EACH).alias("size"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), F.min("child").alias("lo"), F.max("child").alias("hi"))
    nodes = nodes.where(F.col("w") > 1) if depth == full else nodes.where(F.col("lo") != F.col("hi"))
    # of nodes with the same texts the first tree's is enough: all their pairs meet there first, or in a tree before
    nodes = nodes.groupBy("w", "x", "y").agg(F.min(F.struct("tree", "key", "size")).alias("n"))
    nodes = table(nodes.select("n.key", "w", F.ceil(F.col("n.size") / block).cast("int").alias("blocks")))
    total = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    placed = attach(members.select("node", "tree", "key"), nodes, ["key"], "w", total, "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(sets.select("node", "copies", "shingles", "labels"), "node")
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tree", "node", "copies", "block", "shingles", "labels")
    found = table(pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node").mapInArrow(_verified(depth, trees, threshold), _FOUND))
    discard(nodes)
    return found


def classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, row (the row key), class (tells classes apart, also those without an id), class_id, n_links for every row of docs."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    least = floor_depth(threshold, target, trees, depth)
    rows = table(_text.map_text(texts, _first_rows(seed, least, trees, depth), "doc_id long, row binary, node binary, keys array<long>"))
    nodes = table(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("row").alias("pick"), F.first("keys").alias("keys")))
    # texts that share a prefix of the shortest depth with another one; all others are leaves that meet nobody
    shared = table(nodes.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"))
    likely = table(nodes.select("node", "copies", "pick", F.coalesce("keys", F.array().cast("array<long>")).alias("keys")).mapInArrow(_some(_bloom.build(shared, "key")), "node binary, copies long, pick binary"))
    bits = _bloom.build(likely.select(F.xxhash64("pick").alias("hash")), "hash")
    sets = _text.map_text(texts.withColumn("hash", F.xxhash64("row")), _set_rows(seed, trees, depth, bits), "node binary, pick binary, shingles binary, labels binary, size long")
    sets = sets.groupBy("node", "pick").agg(F.first("shingles").alias("shingles"), F.first("labels").alias("labels"), F.first("size").alias("size"))
    sets = table(sets.join(likely, ["node", "pick"]).select("node", "copies", "size", "shingles", "labels").where("labels is not null"))
    discard(shared, likely)
    found, bins = [], np.zeros(BINS, np.int64)
    for d in range(depth, least - 1, -1):
        found.append(_level(sets, d, depth, trees, block, threshold))
        for r in found[-1].where("bin is not null").groupBy("bin").agg(F.sum("pairs").alias("n")).collect():
            bins[r["bin"]] += r["n"]
        if estimated_recall(bins, d, threshold, trees) >= target:
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = links.where("node is not null")
    joined = connected(links.select(F.col("node").alias("a"), F.col("near").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("keys", "pick").join(joined.withColumnRenamed("root", "class"), "node", "left").join(sums, "node", "left")
    known = table(known.select("node", "least", "copies", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(sets, joined, *found)
    names = known.groupBy("class").agg(F.min("least").alias("class_id"), F.count("*").alias("w"))
    known = table(attach(known.select("node", "copies", "class", "n_links"), names, ["class"], "w", known.count(), "inner").select("node", "copies", "class", "class_id", "n_links"))
    return attach(rows.select("doc_id", "row", "node"), known, ["node"], "copies", rows.count(), "inner").select("doc_id", "row", "class", "class_id", "n_links")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs (doc_id, text)."""
    return classes(docs, threshold, target, trees, depth, block, seed).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, one that has the class's doc_id. Columns stay; of rows alike in doc_id and text any one stays."""
    every = table(classes(docs))
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("row")))
    lead = every.groupBy("class").agg(first.alias("row"), F.count("*").alias("n")).where("n > 1")
    lead = table(lead.select("class", "row"))
    several = table(every.where("n_links > 0").select("row").distinct())
    bits = _bloom.build(several.select(F.xxhash64("row").alias("hash")), "hash")

    @pandas_udf(BooleanType())
    def shared(key: pd.Series) -> pd.Series:
        return pd.Series(_bloom.maybe(bits, key.to_numpy(np.int64)))

    whole = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).withColumn("shared", shared(F.xxhash64("row")))
    alone = whole.where("not shared").select("doc")
    # the filter lets a few rows pass that are alone in their class
    mixed = whole.where("shared").groupBy("row").agg(F.first("doc").alias("doc"))
    gone = several.join(lead.select("row"), "row", "left_anti")
    return alone.unionByName(mixed.join(gone, "row", "left_anti").select("doc")).select("doc.*")
