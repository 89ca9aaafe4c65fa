"""Operators 1 and 8 by held-out quality and exact parts, and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from terrane.llm import lm_score, mixing, quality
from tests.llm.test_exact_mix_tokens import brute_targets
from tests.llm.test_near import brute_join, brute_leaks, brute_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def check_base(docs, rows):
    texts = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(LOWER)), ""]) for r in docs.collect()]
    c = Counter(w for i, ws in texts if crc(i, 10) != 0 for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted(((i, crc(i, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in texts), key=str)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows), key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5] for g in got], [e[5] for e in expected], atol=1e-3)


def test_scores_beat_single_words_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lm_score.lm_score(docs).collect()
    check_base(docs, rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_scores_with_a_short_list_of_words(docs_of, words):
    docs = docs_of([" ".join(words(40)) for _ in range(30)])
    rows = lm_score.lm_score(docs, top=50, heads=20).collect()
    check_base(docs, rows)
    full = {r["doc_id"]: r["score"] for r in lm_score.lm_score(docs, heads=20).collect()}
    assert all(r["score"] == pytest.approx(full[r["doc_id"]], abs=1e-6) for r in rows)


def test_scores_of_messy_rows_and_of_nothing(messy, nothing, docs_of):
    rows = lm_score.lm_score(messy).collect()
    assert len(rows) == messy.count()
    check_base(messy, rows)
    assert lm_score.lm_score(nothing).collect() == []
    held = next(i for i in range(1000) if crc(i, 10) == 0)
    alone = lm_score.lm_score(docs_of(["two words"], ids=[held])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in alone] == [(3, 0, 0)] and math.isfinite(alone[0]["score"])


def small_model(rng, n=30):
    """A vocabulary of n words of which 25 are heads, and tokens of a chain in which each word is followed by few others."""
    follow = rng.dirichlet(np.full(n, 0.05), n)
    token, out = 0, []
    for u in rng.random(120_000):
        token = min(int(np.searchsorted(np.cumsum(follow[token]), u)), n - 1)
        out.append(token)
    hashes = lm_score._text.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = np.array(out)
    count = np.bincount(out, minlength=n)
    order = np.argsort(-count)
    heads, others = order[:25], order[25:]
    classes = lm_score.classes_for(25)
    rest = np.zeros(classes, np.int64)
    np.add.at(rest, (hashes[others] % np.uint64(classes)).astype(int), count[others])
    return lm_score.Vocabulary(hashes[heads], count[heads], rest), hashes[out], out, follow


def test_model_is_normalised_and_comes_near_an_exact_one():
    v, token, chain, follow = small_model(np.random.default_rng(0))
    model = lm_score.Model(v)
    number, cls, slot = v(token)
    one, two = v.contexts(number, np.array([0, len(token)]))
    before = model.log(one, two, cls, slot).mean()
    trainer = lm_score.Trainer(model, v, 1)
    for _ in range(12):
        for k in range(0, 100_000, 2000):
            trainer.step(one[k : k + 2000], two[k : k + 2000], cls[k : k + 2000], slot[k : k + 2000])
    model.p = trainer.p
    held = slice(100_000, None)
    after = model.log(one[held], two[held], cls[held], slot[held]).mean()
    # the chain's own probabilities, of common places where words share one
    exact = np.zeros((len(follow), v.classes, v.slots + 1))
    hashes = lm_score._text.mix(np.arange(1, len(follow) + 1, dtype=np.uint64))
    _, c, s = v(hashes)
    for w in range(len(follow)):
        exact[:, c[w], s[w]] += follow[:, w]
    best = np.log(exact[chain[99_999:-1], cls[held], slot[held]]).mean()
    assert after - before > 0.7 * (best - before) > 0
    # every context's probabilities add up to one over all places
    places = [(a, b) for a in range(v.classes) for b in range(v.slots + 1)]
    for x, y in ((0, 3), (25, 30), (v.n + v.classes, v.n + v.classes)):
        p = np.exp(model.log(np.full(len(places), x), np.full(len(places), y), np.array([a for a, _ in places]), np.array([b for _, b in places])).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_partitions_train_one_model(spark):
    v, token, _, _ = small_model(np.random.default_rng(0))
    names = {int(h): f"w{k}" for k, h in enumerate(np.unique(token).tolist())}
    text = [names[int(t)] for t in token]
    docs = [" ".join(text[k : k + 200]) for k in range(0, len(text), 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4, "doc_id")
    rows = lm_score.lm_score(df, heads=30, batch=500).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9
    again = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, heads=30, batch=500).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-3) for r in rows)


def test_alias_tables_give_back_their_probabilities():
    p = np.array([[0.5, 0.2, 0.3, 0.0], [0.25, 0.25, 0.25, 0.25]])
    keep, other = lm_score.alias(p)
    for r in range(2):
        q = keep[r].astype(float) / 4
        np.add.at(q, other[r], (1 - keep[r].astype(float)) / 4)
        assert np.allclose(q, p[r], atol=1e-6)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(rows[i], y) for i, y in truth.items() if crc(i, 4) == 2]
    assert all(r["held_out"] for r, _ in held) and len(rows) == docs.count()
    assert sum(r["predicted"] == y for r, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    # labels of held-out rows teach nothing
    flipped = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(r["score"], abs=1e-6) for i, r in rows.items())


def test_quality_of_odd_tables(spark, messy, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, 1), (3, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {(r["score"], r["predicted"]) for r in quality.quality(messy, labels.limit(0)).collect()} == {(1.0, 1)}
    assert {r["score"] >= 0.9 for r in quality.quality(messy, labels.where("doc_id = 0")).collect()} == {True}
    assert quality.quality(nothing, labels).collect() == []


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 2, 1, 3, 0]), np.array([2.0, 2, 2, 3, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0
    assert (x[0], y[-1]) == (0.0, 0.75)


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    good = {r["doc_id"] for r in quality.quality(docs, labels).collect() if r["score"] >= 0.7}
    rows = {r["doc_id"]: r.asDict() for r in docs.collect() if r["doc_id"] in good}
    for i, text, _ in brute_lines([(i, r["text"]) for i, r in rows.items()]):
        rows[i]["text"] = text
    kept = {c for _, c, _ in brute_join([(i, r["text"]) for i, r in rows.items()])}
    leaks = {i for i, _ in brute_leaks([(i, rows[i]["text"]) for i in kept], [(r["item_id"], r["text"]) for r in bench.collect()])}
    left = {i: rows[i] for i in kept - leaks}
    sizes = defaultdict(int)
    for r in left.values():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    goal = brute_targets(sizes)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    taken, size = defaultdict(int), lambda i: len(WORD.findall(left[i]["text"] or ""))
    plan = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in left.values()], "doc_id long, text string, source string")).collect()}
    assert {r["doc_id"] for r in got} == {i for i, r in plan.items() if r["taken"] > 0} <= set(left)
    for r in got:
        n = len(WORD.findall(r["text"]))
        assert r["text"] == left[r["doc_id"]]["text"] or WORD.findall(left[r["doc_id"]]["text"])[:n] == WORD.findall(r["text"])
        assert r["source"] == left[r["doc_id"]]["source"] and r["n_chars"] == len(r["text"]) and n <= size(r["doc_id"])
        taken[r["doc_id"]] += n
    assert all(n == plan[i]["taken"] for i, n in taken.items())
    by_source = defaultdict(int)
    for i, n in taken.items():
        by_source[left[i]["source"]] += n
    assert all(n == int(goal[s] + 1e-9) for s, n in by_source.items())


def test_pipeline_of_messy_and_of_empty_tables(spark, messy, nothing, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "an id is missing here"), (None, None)], "item_id long, text string")
    for k, (docs, marks, bench) in enumerate([(messy, labels, items), (messy, labels.limit(0), items.limit(0)), (nothing, labels, items)]):
        where = f"{tmp_path}/{k}"
        for name, table in (("documents", docs), ("labels", marks), ("benchmark", bench)):
            table.write.parquet(f"{where}/{name}.parquet")
        rows = corpus_pipeline.run(spark, where).collect()
        assert (len(rows) > 0) == (k == 1) or k == 0
        assert k != 0 or not any(r["text"] == "an id is missing here" for r in rows)


def test_a_rejected_row_does_not_take_others_of_its_id_along(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, labels).collect()}
    some = docs.where("doc_id < 400").collect()
    kept = quality.accepted(docs.unionByName(docs_of([r["text"] for r in some], ids=[None] * len(some))), labels)
    lone = sorted(r["text"] for r in kept.where("doc_id is null").collect())
    assert lone == sorted(r["text"] for r in some if told[r["doc_id"]]) and 0 < len(lone) < len(some)


def test_stages_keep_the_columns_of_documents(spark, sf_dir, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            # columns that a stage doesn't work on stay as they are
            assert {r["n_lines"] for r in out.select("n_lines").collect()} <= {20} if "n_lines" in docs.columns else out.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns == [*docs.columns, "epoch"]
