"""Operator 1: language-model scores of a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a token from the two before it: their vectors, each scaled by a vector of its place, are
added to a predicted vector. The HEADS most frequent words are dealt to classes, about as many as a class has words; the product of the predicted vector
with a class's vector plus its bias is the class's score, and in the class the same holds for its words. All other words
share one place in the class that their hash picks, and are told apart in it by their corpus counts. A softmax over the classes, one over
the words of the class and the share in a common place make log-probabilities that add up to one over all words.

Training reads every token of the training documents once, in ROUNDS passes over a share of the documents each. In a pass every
partition starts from the common weights and takes minibatch steps in numpy: NOISE_CLASSES classes drawn for the batch and NOISE_WORDS words of
the class drawn for each token are told from the true ones (noise-contrastive estimation), with a step size for each vector. Afterwards the
partitions' weights are averaged, each vector weighted by how often a partition has met it, slice by slice in the cluster; only
the average, whose size is the model's, goes to the driver. Draws depend on the seed and the partition alone.

For scoring, batches of matrix products give all classes' scores, and those of all words of the classes that occur.

Words are counted over the whole corpus in a distributed table. At most TOP of the most frequent ones are sent to all tasks;
occurrences of others, each of which is rare, are joined with the table by shuffle.

Defined results: a null text is empty and is scored as the end token alone; a null doc_id counts as the empty
string for the held-out rule. Repeated rows each give a row and count each. Without any training text,
all counts are 0 and both scores are those of one unknown word after another. An empty table gives an empty result,
other columns are ignored, whatever their names. A very long text is read by one task, in memory in proportion to its bytes.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _text
from terrane.llm._spark import ship, table

HEADS = 1 << 14
TOP = 1 << 18
WIDTH = 16
NOISE_CLASSES = 16
NOISE_WORDS = 4
BATCH = 8192
ROUNDS = 2
RATE = 0.05
SLICES = 64
SCORED = 1 << 16
STRIP = 1024
ADD = 0.1
FOLDS = 10
SEED = 3
_END = np.uint64(0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row closed by the end token; their rows; and the rows' bounds."""
    w = _text.words(texts)
    n = len(w.first) - 1
    out = np.full(len(w.hash) + n, _END, np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    first = w.first + np.arange(n + 1)
    return out, np.repeat(np.arange(n), np.diff(first)), first


def _count_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    token, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(_text.signed(token)), pa.array(n)], names=["token", "c"])


class Lookup:
    """Numbers of the given hashes; all others get the number of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes).astype(np.int64)
        self.sorted, self.n = hashes[self.order], len(hashes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, x), self.n - 1)
        return np.where(self.sorted[at] == x, self.order[at], self.n)


class Vocabulary:
    """Places of tokens: head words by number, all others by hash."""

    def __init__(self, heads: np.ndarray, counts: np.ndarray, rest: np.ndarray, add: float = ADD):
        """heads, counts: hashes of the head words and their counts; rest: counts of all other words by class (classes_for(len(heads)) of them)."""
        self.heads, self.n = heads, len(heads)
        self.classes = classes_for(self.n)
        self.slots = math.ceil(self.n / self.classes)  # and one for all other words
        self.unigram = np.zeros((self.classes, self.slots + 1))
        k = np.arange(self.n)
        self.unigram[k % self.classes, k // self.classes] = counts + add
        self.unigram[:, -1] = rest + add
        self._lookup: Lookup | None = None

    def __call__(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number as a context, class, and place in the class of each token."""
        if self._lookup is None:
            self._lookup = Lookup(self.heads)
        number = self._lookup(token)
        other = (token % np.uint64(self.classes)).astype(np.int64)
        known = number < self.n
        return np.where(known, number, self.n + other), np.where(known, number % self.classes, other), np.where(known, number // self.classes, self.slots)

    def contexts(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the last token and the one before it, for each token; a text starts after start symbols."""
        start = self.n + self.classes
        one, two = np.full(len(number), start), np.full(len(number), start)
        one[1:], two[2:] = number[:-1], number[:-2]
        begin = first[:-1]
        one[begin] = two[begin] = start
        second = begin + 1
        two[second[second < first[1:]]] = start
        return one, two


def classes_for(heads: int) -> int:
    return max(1, math.isqrt(max(heads - 1, 0)) + 1)


def alias(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables that draw from each row of p: a place k is kept with probability keep[k], else other[k] is taken."""
    p = p / p.sum(1, keepdims=True) * p.shape[1]
    keep, other = np.ones_like(p), np.tile(np.arange(p.shape[1]), (len(p), 1))
    for r, row in enumerate(p.tolist()):
        small, large = [k for k, x in enumerate(row) if x < 1], [k for k, x in enumerate(row) if x >= 1]
        while small and large:
            s, g = small.pop(), large[-1]
            keep[r, s], other[r, s] = row[s], g
            row[g] -= 1 - row[s]
            if row[g] < 1:
                small.append(large.pop())
    return keep.astype(np.float32), other


def _sums(index: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of g by index."""
    out = np.zeros(rows * g.shape[1], np.float32)
    np.add.at(out, (index[:, None] * g.shape[1] + np.arange(g.shape[1])).ravel(), g.ravel())
    return out.reshape(rows, -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_softmax(q: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of q the logarithm of the share of the row `at` of w; scores beyond 80 count as 80, so no sum overflows. Blocks of STRIP rows stay in the processor's cache."""
    columns, ones = np.ascontiguousarray(w.T), np.ones(len(w), np.float32)
    longest, bias = np.sqrt((w[:, :-1] ** 2).sum(1).max()), w[:, -1].max()
    out = np.empty(len(q), np.float32)
    for k in range(0, len(q), STRIP):
        part = q[k : k + STRIP]
        s = part @ columns
        # no product is greater than that of the lengths; the last column of w is the bias
        if np.sqrt((part[:, :-1] ** 2).sum(1).max()) * longest + bias > 80:
            np.minimum(s, 80, out=s)
        own = s[np.arange(len(s)), at[k : k + STRIP]]
        np.exp(s, out=s)
        out[k : k + STRIP] = own - np.log(s @ ones)
    return out


class Model:
    """Weights, all tables of rows: context vectors, scales of the two places, and vectors with bias of classes and of their words."""

    def __init__(self, vocabulary: Vocabulary, width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        v, u = vocabulary, vocabulary.unigram
        self.shape = u.shape
        self.p = {"context": rng.normal(0, 0.3, (v.n + v.classes + 1, width)), "scale": np.ones((2, width)), "class": np.zeros((v.classes, width + 1)), "word": np.zeros((u.size, width + 1))}
        self.p["class"][:, -1] = np.log(u.sum(1) / u.sum())
        with np.errstate(divide="ignore"):
            # places without a word are never drawn or met
            self.p["word"][:, -1] = np.maximum(np.log(u / u.sum(1, keepdims=True)), -1e4).ravel()
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        q = self.p["context"][one] * self.p["scale"][0] + self.p["context"][two] * self.p["scale"][1]
        return np.hstack([q, np.ones((len(q), 1), np.float32)])

    def log(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of (cls, slot) after the contexts."""
        q = self.predicted(one, two)
        word = self.p["word"].reshape(*self.shape, -1)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.shape[0] + 1))
        out = _log_softmax(q, self.p["class"], cls)
        for c in np.flatnonzero(np.diff(bounds)):
            k = order[bounds[c] : bounds[c + 1]]
            out[k] += _log_softmax(q[k], word[c], slot[k])
        return out


class Trainer:
    """Minibatch steps on a copy of a model's weights; counts how often each row of each table has been met."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int, rate: float = RATE):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.p = {k: x.copy() for k, x in model.p.items()}
        self.work = Model.__new__(Model)
        self.work.p, self.work.shape = self.p, model.shape
        u = vocabulary.unigram
        self.class_p, self.word_p = u.sum(1) / u.sum(), u / u.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.class_shift, self.word_shift = np.log(NOISE_CLASSES * self.class_p).astype(np.float32), np.log(NOISE_WORDS * self.word_p).astype(np.float32)
        self.keep, self.other = alias(u)
        self.class_sums = np.cumsum(self.class_p)
        self.energy = {k: np.full(len(x), 1e-2, np.float32) for k, x in self.p.items()}
        self.met = {k: np.zeros(len(x), np.float32) for k, x in self.p.items()}

    def step(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> None:
        p, n, slots = self.p, len(one), self.model.shape[1]
        q = self.work.predicted(one, two)
        width = q.shape[1] - 1
        # classes: the true one and those drawn for the batch
        drawn = np.minimum(np.searchsorted(self.class_sums, self.rng.random(NOISE_CLASSES)), len(self.class_sums) - 1)
        true = 1 - _sigmoid((q * p["class"][cls]).sum(1) - self.class_shift[cls])
        fake = -_sigmoid(q @ p["class"][drawn].T - self.class_shift[drawn])
        dq = true[:, None] * p["class"][cls] + fake @ p["class"][drawn]
        grad = {"class": _sums(np.concatenate([cls, drawn]), np.vstack([true[:, None] * q, fake.T @ q]), len(p["class"]))}
        met = {"class": np.concatenate([cls, drawn])}
        # words of the class: the true one and those drawn for each token
        k = self.rng.integers(0, slots, (n, NOISE_WORDS))
        c = cls[:, None]
        k = np.where(self.rng.random((n, NOISE_WORDS), np.float32) < self.keep[c, k], k, self.other[c, k])
        place = np.concatenate([slot[:, None], k], 1)
        at = c * slots + place
        w = p["word"][at]
        g = -_sigmoid(np.einsum("nd,nkd->nk", q, w) - self.word_shift[c, place])
        g[:, 0] += 1
        dq += np.einsum("nk,nkd->nd", g, w)
        grad["word"] = _sums(at.ravel(), (g[:, :, None] * q[:, None]).reshape(-1, width + 1), len(p["word"]))
        met["word"] = at.ravel()
        dq = dq[:, :width]
        a, b = p["context"][one], p["context"][two]
        grad["scale"] = np.stack([(dq * a).sum(0), (dq * b).sum(0)])
        grad["context"] = _sums(np.concatenate([one, two]), np.vstack([dq * p["scale"][0], dq * p["scale"][1]]), len(p["context"]))
        met |= {"context": np.concatenate([one, two]), "scale": np.repeat([0, 1], n)}
        for name, x in p.items():
            self.energy[name] += (grad[name] ** 2).mean(1)
            x += self.rate * grad[name] / np.sqrt(self.energy[name])[:, None]
            self.met[name] += np.bincount(met[name], minlength=len(x))


def _joined(tables: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in tables.values()])


def train(texts: DataFrame, model: Model, vocabulary: Vocabulary, seed: int, batch: int = BATCH) -> None:
    """One pass of all partitions over texts (text); sets the model's weights to their average."""
    sizes = {k: x.shape for k, x in model.p.items()}
    total = sum(a * b for a, b in sizes.values())
    edges = np.linspace(0, total, SLICES + 1).astype(int)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, held, n = Trainer(model, vocabulary, seed + TaskContext.get().partitionId()), [], 0
        for b in batches:
            for lo, hi in _text.slices(b.column("text")):
                token, _, first = tokens(b.column("text").slice(lo, hi - lo))
                number, cls, slot = vocabulary(token)
                held.append(np.stack([*vocabulary.contexts(number, first), cls, slot]))
                n += len(token)
                if n >= batch:
                    every = np.concatenate(held, 1)
                    whole = n // batch * batch
                    for k in range(0, whole, batch):
                        trainer.step(*every[:, k : k + batch])
                    held, n = [every[:, whole:]], n - whole
        if n:
            trainer.step(*np.concatenate(held, 1))
        if trainer.met["scale"].any():
            values, weights = _joined(trainer.p), np.concatenate([np.repeat(trainer.met[k], sizes[k][1]) for k in sizes])
            parts = [(values[a:b] * weights[a:b].astype(np.float64), weights[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v, _ in parts], pa.binary()), pa.array([w.tobytes() for _, w in parts], pa.binary())], names=["slice", "sums", "weights"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, v, w in zip(*(b.column(c).to_pylist() for c in ("slice", "sums", "weights")), strict=True):
                old = sums.setdefault(k, [0.0, 0.0])
                old[0], old[1] = old[0] + np.frombuffer(v, np.float32).astype(np.float64), old[1] + np.frombuffer(w, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(v / np.maximum(w, 1e-9)).astype(np.float32).tobytes() for v, w in sums.values()], pa.binary()), pa.array([(w > 0).tobytes() for _, w in sums.values()], pa.binary())], names=["slice", "sums", "weights"])

    schema = "slice long, sums binary, weights binary"
    # a row for each slice; together they have the model's size
    rows = texts.mapInArrow(learn, schema).repartition(SLICES, "slice").mapInArrow(merge, schema).collect()
    flat = _joined(model.p)
    for r in rows:
        a, b = edges[r["slice"]], edges[r["slice"] + 1]
        flat[a:b] = np.where(np.frombuffer(r["weights"], bool), np.frombuffer(r["sums"], np.float32), flat[a:b])
    at = 0
    for k, (m, w) in sizes.items():
        model.p[k] = flat[at : at + m * w].reshape(m, w)
        at += m * w


def lm_score(docs: DataFrame, heads: int = HEADS, top: int = TOP, rounds: int = ROUNDS, batch: int = BATCH, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0)
    training = texts.where(~F.col("held_out")).select("text")
    counts = table(_text.map_text(training, _count_rows, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    n, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    frequent = _frequent(counts, heads, top)
    top_hash, top_count = frequent["token"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(np.int64)
    words = top_hash != _END
    head_hash = np.concatenate([top_hash[words][: heads - 1], [_END]]).astype(np.uint64)
    head_count = np.concatenate([top_count[words][: heads - 1], [top_count[~words].sum()]]).astype(np.int64)
    # of the other words: occurrences and distinct words by class
    classes = classes_for(len(head_hash))
    of = F.pmod(F.pmod("token", F.lit(classes)) + F.when(F.col("token") < 0, F.lit((1 << 64) % classes)).otherwise(0), F.lit(classes)).cast("int").alias("class")
    rest = np.zeros((2, classes), np.int64)
    for r in counts.groupBy(of).agg(F.sum("c").alias("c"), F.count("*").alias("d")).collect():
        rest[:, r["class"]] = r["c"], r["d"]
    own = (head_hash % np.uint64(classes)).astype(np.int64)
    np.subtract.at(rest, (0, own), head_count)
    np.subtract.at(rest, (1, own), (head_count > 0).astype(np.int64))
    vocabulary = Vocabulary(head_hash, head_count, rest[0])
    model = Model(vocabulary, seed=seed)
    share = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds if n else 0):
        train(training.where(share == k), model, vocabulary, seed * 1000 + k, batch)
    base_log = math.log10(n + ADD * (distinct + 1))
    rest_log = np.log10(rest[0] + ADD * (rest[1] + 1))

    def score_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        from pyspark import TaskContext

        token, row, first = tokens(batch.column("text"))
        size = batch.num_rows
        number, cls, slot = vocabulary(token)
        one, two = vocabulary.contexts(number, first)
        p = np.concatenate([model.log(*(x[k : k + SCORED] for x in (one, two, cls, slot))).astype(float) for k in range(0, len(token), SCORED)]) / math.log(10)
        other = slot == vocabulary.slots
        p[other] -= rest_log[cls[other]]
        known = _lookup(top_hash)(token)
        listed = known < len(top_hash)
        log_count = np.append(np.log10(top_count + ADD), 0.0)[known]
        total = lambda x: np.bincount(row, x, minlength=size)
        base, inner = total(log_count), total(np.where(other & listed, log_count, 0.0))
        ids = _next_ids(TaskContext.get().partitionId(), size)
        # words outside the list: their counts come from the table
        pair = np.stack([row[~listed].astype(np.uint64), token[~listed]], 1)
        pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]).any(1)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair)))
        owner = pair[at, 0].astype(np.int64)
        m = len(at)
        fill = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids, ids[owner]])),
                pa.array(np.concatenate([_text.signed(_text.mix(ids.view(np.uint64))), _text.signed(pair[at, 1])])),
                pa.array(np.concatenate([np.zeros(size, np.int64), times])),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([batch.column("held_out"), pa.nulls(m, pa.bool_())]),
                fill(np.diff(first), pa.int64()),
                fill(total(listed & (np.append(top_count, 0)[known] > 0)).astype(np.int64), pa.int64()),
                fill(base - np.diff(first) * base_log, pa.float64()),
                fill(total(p) + inner, pa.float64()),
            ],
            names=["rid", "token", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    schema = "rid long, token long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    rows = _text.map_text(texts, score_rows, schema).join(counts, "token", "left")
    log = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))
    rows = rows.select("rid", "doc_id", "held_out", "n_tokens", F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).alias("more"), "n_known", F.when(F.col("times") > 0, log).otherwise(0.0).alias("log"), "base_score", "score")
    out = rows.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum("more")).alias("n_known"), (F.max("base_score") + F.sum("log")).alias("base_score"), (F.max("score") + F.sum("log")).alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _frequent(counts: DataFrame, heads: int, top: int) -> pd.DataFrame:
    """All words above a count that at most `top` words reach, and as many more as make up `heads`, most frequent first.

    The bound comes from a histogram of the counts' logarithms, so no task sends more than the words that are kept.
    """
    octave = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("n")).collect()  # under 512 rows
    bound, held, after = 1 << 30, 0, None
    for r in sorted(sizes, key=lambda r: -r["octave"]):
        if held + r["n"] > top:
            after = r["octave"]
            break
        held += r["n"]
        bound = r["octave"]
    many = counts.where(octave >= bound).toPandas()
    if held < heads and after is not None:
        many = pd.concat([many, counts.where(octave == after).orderBy(F.desc("c"), "token").limit(heads - held).toPandas()])
    return many.sort_values(["c", "token"], ascending=[False, True], ignore_index=True)


_cache: dict[str, tuple] = {}
_counter: dict[int, int] = {}


def _lookup(hashes: np.ndarray) -> Lookup:
    if "top" not in _cache or _cache["top"][0] is not hashes:
        _cache["top"] = (hashes, Lookup(hashes))
    return _cache["top"][1]


def _next_ids(partition: int, n: int) -> np.ndarray:
    """Numbers of the next n rows of this task: partition, then place in it."""
    from pyspark import TaskContext

    attempt = TaskContext.get().taskAttemptId()
    begin = _counter.get(attempt, 0)
    _counter.clear()
    _counter[attempt] = begin + n
    return np.arange(begin, begin + n, dtype=np.int64) + (partition << 33)
