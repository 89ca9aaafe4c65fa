"""Operator 8: quality scores from random Fourier features, ridge regression and isotonic calibration.

Statistics of a document's text are standardised and mapped to cosines of random projections, which
approximate a Gaussian kernel. Every partition sums its share of the normal equations of the labelled rows;
the sums are added up by fold, so a model without any one fold costs no further pass. Scores of rows by
the model that has not seen their fold are binned, and pool-adjacent-violators turns the bins into a
non-decreasing calibration. All labelled rows outside the held-out quarter take part.

Defined results: a null text is empty and gets a score like any other; a null doc_id counts as the empty string
for the held-out rule and has no label. Labels that are null are skipped, repeated ones all count. Without
any label to learn from, every score is 1, so nothing is rejected. An empty table gives an empty result;
other columns are ignored, whatever their names. Rows that repeat a doc_id are scored each by its own text. Statistics of a very
long text are made in one task, in memory in proportion to its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import _text
from terrane.llm._spark import row_key, table, without

FEATURES = 256
WIDTH = 1.0
RIDGE = 0.1
SEED = 17
THRESHOLD = 0.7
HELD_OUT = 2
FOLDS = (0, 1, 3)
BINS = 2000
GROUPS = 8
#: Labelled rows in a partition of sums.
PER_SUM = 1 << 14

_SETS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:?",
    "shout": b"!",
    "quote": b"'\"()-",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "space": b" ",
    "tab": b"\t\r\x0b\x0c",
    "line": b"\n",
    "high": range(128, 256),
}
_MEMBER = np.zeros((len(_SETS), 256), bool)
for _k, _v in enumerate(_SETS.values()):
    _MEMBER[_k, list(_v)] = True
_MARK = _MEMBER[[list(_SETS).index(x) for x in ("shout", "bar", "symbol")]].any(0)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each row has, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, r[first], runs)
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, at = _text.raw(texts)
    n, size = len(texts), np.maximum(np.diff(at), 1).astype(float)
    counts = {k: _per_row(_MEMBER[i][data], at) for i, k in enumerate(_SETS)}
    w = _text.words(texts)
    row, length = w.row, (w.end - w.start).astype(float)
    many = np.maximum(w.counts, 1).astype(float)
    total = lambda x: np.bincount(row, x, minlength=n)
    mean = total(length) / many
    spread = np.sqrt(np.maximum(total(length**2) / many - mean**2, 0))
    in_word = lambda flags: (s := np.append(0, np.cumsum(flags)))[w.end] - s[w.start]
    upper, digit, mark = in_word(_MEMBER[0][data]), in_word(_MEMBER[2][data]), in_word(_MARK[data])
    distinct, most = _distinct(w.hash, row, n)
    pair = w.hash[:-1] * np.uint64(3) + w.hash[1:] if len(w.hash) > 1 else np.zeros(0, np.uint64)
    joint = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    pairs, most_pair = _distinct(pair[joint], row[:-1][joint] if len(row) > 1 else row[:0], n)
    # lines, by a hash of their bytes
    start, end = _text.spans(data, at, np.arange(256) == 10)
    line_row = np.searchsorted(at, start, side="right") - 1
    lines = np.bincount(line_row, minlength=n).astype(float)
    unlike, most_line = _distinct(_text.hash_spans(w.low, start, end), line_row, n)
    line = np.maximum(lines, 1)
    letters = np.maximum(counts["upper"] + counts["lower"] + counts["high"], 1)
    columns = [np.log1p(np.diff(at)), np.log1p(w.counts), np.minimum(mean, 50), np.minimum(spread, 50), np.log1p(lines), np.log(size / line)]
    columns += [counts[k] / size for k in _SETS]
    columns += [counts["upper"] / letters, total(length <= 3) / many, total(length >= 14) / many, total((upper >= 2) & (upper * 2 > length)) / many, total(digit > 0) / many, total(mark > 0) / many]
    columns += [distinct / many, most / many, pairs / np.maximum(many - 1, 1), most_pair / many, unlike / line, most_line / line]
    return np.nan_to_num(np.stack(columns, 1)).astype(np.float32)


def _feature_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = statistics(batch.column("text"))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "row", "stats"])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _matrix(column) -> np.ndarray:
    blobs = column.to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)


def _summed(df: DataFrame, kernel) -> dict[int, np.ndarray]:
    """By fold, the sum over all rows (fold, stats, label) of the matrix that kernel makes of some of them.

    Partitions sum first; their sums are added in GROUPS tasks, and those few go to the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                fold, x, y = np.asarray(b.column("fold")), _matrix(b.column("stats")), np.asarray(b.column("label"), float)
                for f in np.unique(fold).tolist():
                    sums[f] = sums.get(f, 0) + kernel(x[fold == f], y[fold == f])
        if sums:
            yield out(sums, TaskContext.get().partitionId() % GROUPS)

    def out(sums: dict[int, np.ndarray], group: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group] * len(sums), pa.int64()), pa.array(list(sums), pa.int64()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], names=["group", "fold", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for f, v in zip(b.column("fold").to_pylist(), b.column("sums").to_pylist(), strict=True):
                sums[f] = sums.get(f, 0) + np.frombuffer(v)
        if sums:
            yield out(sums, 0)

    schema = "group long, fold long, sums binary"
    rows = df.mapInArrow(partial, schema).repartition(GROUPS, "group").mapInArrow(merge, schema).collect()
    found: dict[int, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: bytes(r["sums"])):  # an order of its own, as sums of doubles depend on it
        found[r["fold"]] = found.get(r["fold"], 0) + np.frombuffer(r["sums"])
    return found


def _projection(d: int, features: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / (width * np.sqrt(d)), (d, features)), rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.sqrt(2 / len(phase)) * np.cos(np.clip((x - mean) / scale, -6, 6) @ omega + phase)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and non-decreasing means of the blocks of x, in order, of sums `total`."""
    blocks: list[list[float]] = []
    for a, s, w in zip(x.tolist(), total.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def quality(docs: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: (doc_id, quality)."""
    return scored(docs, labels, features, width, ridge, seed, threshold).drop("row")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are predicted to be good. Columns stay."""
    return without(docs, table(scored(docs, labels, **options).where("predicted = 0").select("row").distinct()))


def scored(docs: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """Like quality, with the row key."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    stats = table(_text.map_text(texts, _feature_rows, "doc_id long, row binary, stats binary"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where("label is not null")
    fold = remainder(F.col("doc_id"), 4).cast("long").alias("fold")
    known = table(stats.join(marks, "doc_id").select(fold, "stats", "label").where(F.col("fold") != HELD_OUT))
    # every partition sends its sums, so their number follows the labels', not the input's
    known = known.repartition(max(1, math.ceil(known.count() / PER_SUM)))
    moments = _summed(known, lambda x, y: np.vstack([np.full((1, x.shape[1]), len(x)), x.sum(0), (x**2).sum(0)]).ravel())
    if not moments:
        return stats.select("doc_id", "row", (remainder(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    n, first, second = sum(moments.values()).reshape(3, -1)
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    omega, phase = _projection(len(mean), features, width, seed)
    d = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale, omega, phase)
        return np.vstack([z.T @ z, (z.T @ y)[None]]).ravel()

    sums = {f: v.reshape(d + 1, d) for f, v in _summed(known, normal).items()}
    penalty = ridge * np.eye(d)
    penalty[-1, -1] = 1e-6
    solve = lambda parts: np.linalg.solve(sum(p[:d] for p in parts) + penalty, sum(p[d] for p in parts))
    everything = solve(sums.values())
    others = {f: solve([v for g, v in sums.items() if g != f]) if len(sums) > 1 else everything for f in sums}

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fold, z = np.asarray(b.column("fold")), fourier(_matrix(b.column("stats")), mean, scale, omega, phase)
                s = sum((fold == f) * (z @ c) for f, c in others.items())
                bins = np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("label")], names=["bin", "label"])

    binned = known.mapInArrow(outside, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("s"), F.count("*").alias("w")).orderBy("bin").collect()
    bins = np.array([tuple(r) for r in binned], float)
    at, level = isotonic((bins[:, 0] + 0.5) / BINS * 2 - 0.5, bins[:, 1], bins[:, 2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = fourier(_matrix(b.column("stats")), mean, scale, omega, phase) @ everything
                # a hundredth of the raw score keeps the order inside flat parts of the calibration
                p = np.clip(0.99 * np.interp(s, at, level) + 0.01 * np.clip((s + 0.5) / 2, 0, 1), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(p)], names=["doc_id", "row", "score"])

    out = stats.mapInArrow(score, "doc_id long, row binary, score double")
    return out.select("doc_id", "row", (remainder(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
