"""Operators 4, 5, 9 and 10 against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np

from terrane.llm import _spark, decontaminate, line_dedup, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles_of(words):
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute_join(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of each row."""
    seqs = [tuple(words_of(t)) for _, t in rows]
    sets = {s: shingles_of(s) for s in set(seqs)}
    texts = sorted(sets)
    near, up = defaultdict(set), {s: s for s in texts}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both / len(sets[a] | sets[b]) >= threshold:
                near[a].add(b)
                near[b].add(a)
                up[find(a)] = find(b)
    copies, least = defaultdict(int), {}
    for (i, _), s in zip(rows, seqs, strict=True):
        copies[s] += 1
        if i is not None:
            r = find(s)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, least.get(find(s)), copies[s] - 1 + sum(copies[x] for x in near[s])) for (i, _), s in zip(rows, seqs, strict=True)), key=str)


def near_texts(words, rng):
    texts = []
    for size in (8, 40, 200):
        base = words(size)
        for edits in (0, 0, 1, 1, 2, 3, 5):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = rng.choice(words(1))
            texts.append(" ".join(new))
    chain = words(120)
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 20, 4)]
    hub = words(60)
    texts += [" ".join([*hub, w]) for w in words(60)]
    return texts + [" ".join(words(50)) for _ in range(40)] + ["a b", "a B", "a b c", "", " "]


def check_join(docs, **options):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs, **options).collect()), key=str)
    assert got == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_matches_brute_force(docs_of, words, rng):
    texts = near_texts(words, rng)
    check_join(docs_of(texts))
    check_join(docs_of(texts), block=3000)


def test_join_on_the_tables(spark, sf_dir):
    check_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_join_of_messy_rows_and_of_nothing(messy, nothing):
    check_join(messy)
    assert ngram_join.ngram_join(nothing).collect() == []


def test_one_row_of_each_class_stays(messy, docs_of, words, rng):
    texts = near_texts(words, rng)
    docs = docs_of(texts + texts[:3], ids=[*range(len(texts)), 0, 1, 2])
    for d in (docs, messy):
        kept = ngram_join.keep_one(d)
        assert kept.columns == d.columns
        classes = {(c) for _, c, _ in brute_join([(r["doc_id"], r["text"]) for r in d.collect()])}
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(ids, key=str) == sorted(classes, key=str)


def test_classes_without_ids_or_with_the_same_id_keep_a_row_each(docs_of, words):
    lone, shared = [words(30) for _ in range(4)], [words(30) for _ in range(3)]
    near = [*lone[0][:-1], "changed"]
    texts = [" ".join(w) for w in (*lone, near, *shared, shared[0])]
    docs = docs_of(texts, ids=[None] * 5 + [7] * 3 + [3])
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) == 7
    assert sum(t in (texts[0], texts[4]) for _, t in kept) == 1
    assert {(None, t) for t in texts[1:4]} | {(7, t) for t in texts[6:8]} | {(3, texts[5])} <= set(kept)


def test_recall_rises_as_prefixes_shorten():
    assert ngram_join.floor_depth(0.8, 0.9999) == 5
    assert ngram_join.floor_depth(0.8, 0.5) == 7
    assert ngram_join.recall(5, 0.8) > 0.9999 > ngram_join.recall(6, 0.8)
    equal, mixed, none = np.zeros(20), np.ones(20), np.zeros(20)
    equal[-1] = 100
    assert ngram_join.estimated_recall(equal, 7, 0.8) > 0.9999 > ngram_join.estimated_recall(mixed, 7, 0.8)
    assert ngram_join.estimated_recall(none, 7, 0.8) == 0


def test_deep_prefixes_find_less_until_they_are_shortened(docs_of, words, rng):
    texts = []
    for _ in range(60):
        base = words(100)
        texts += [" ".join(base), " ".join([*base[:50], *words(2), *base[52:]]), " ".join([*base[:30], *words(1), *base[31:]])]
    docs = docs_of(texts)
    links = lambda **k: sum(r["n_links"] for r in ngram_join.ngram_join(docs, **k).collect())
    every = sum(n for _, _, n in brute_join(list(enumerate(texts))))
    assert links(trees=3, depth=6, target=0.2) < links(trees=24, depth=6) == every


def test_components_of_a_long_chain_and_a_star(spark):
    ids = np.random.default_rng(3).permutation(10_000).tolist()
    chain, star = ids[:7000], ids[7000:]
    edges = [*zip(chain, chain[1:]), *((star[0], x) for x in star[1:]), (chain[0], chain[0])]
    got = {r["node"]: r["root"] for r in _spark.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(chain, min(chain)) | dict.fromkeys(star, min(star))


def test_join_of_a_long_chain_and_many_copies_of_one_text(docs_of, words):
    base = words(3100)
    chain = [" ".join(base[k : k + 100]) for k in range(0, 2700, 9)]
    hub = words(50)
    docs = docs_of([*chain, *[" ".join(hub)] * 200, *(" ".join([*hub, w]) for w in words(60))])
    check_join(docs)
    check_join(docs, block=9000)


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(rows):
    """text and removed line numbers by row: a line goes if it is a copy of an earlier one that stays."""
    lines = []
    for r, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            lines.append(((i is not None, i or 0, k), row_hash(i, t), r, tuple(words_of(line))))
    gone, stay = defaultdict(set), {}
    for at, key, r, w in sorted(lines, key=lambda x: x[:3]):
        if not w:
            continue
        place = (at, key)
        first = stay.get(w)
        if first is not None:
            if first != place:
                gone[r].add(at[2])
        elif len(w) >= 8 and any(len(v) >= 8 and abs(len(v) - len(w)) <= 1 and within_one(w, v) for v, p in stay.items() if p):
            gone[r].add(at[2])
            stay[w] = ()
        else:
            stay[w] = place
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r]), len(gone[r])) for r, (i, t) in enumerate(rows)]


def row_hash(i, t):
    return hashlib.md5(f"{'-' if i is None else i}:{t or ''}".encode()).digest()


def check_lines(docs):
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect()), key=str)
    assert got == sorted(brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)


def test_line_dedup_matches_brute_force(docs_of, words, rng):
    stock = [words(n) for n in (1, 1, 2, 3, 7, 8, 8, 9, 10, 20, 21, 40) for _ in range(3)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(stock))
            kind = rng.randrange(5)
            k = rng.randrange(len(line))
            if kind == 1:
                line[k] = rng.choice(words(1))
            elif kind == 2:
                line.insert(k, rng.choice(words(1)))
            elif kind == 3 and len(line) > 1:
                del line[k]
            lines.append(" ".join(line) if rng.random() < 0.9 else "")
        texts.append("\n".join(lines))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    check_lines(docs_of(texts, ids=ids))


def test_a_line_near_one_that_has_gone_stays(docs_of, words):
    a, other = words(16), words(3)
    b = [*a[:3], other[0], *a[4:]]
    c = [*b[:9], other[1], *b[10:]]
    d = [*c[:14], other[2], *c[15:]]
    docs = docs_of([" ".join(x) for x in (a, b, c, d, c, b)])
    assert [r["n_removed"] for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()] == [0, 1, 0, 1, 1, 1]
    check_lines(docs)


def test_columns_with_names_of_any_kind_stay(spark, docs_of, words):
    texts = [" ".join(words(20))] * 2 + ["one\ntwo", "two\none"]
    names = ["_of", "_removed", "_spans", "_good", "_text", "_row", "_heavy", "_salt", "row", "doc", "removed", "hit", "shared", "class"]
    docs = docs_of(texts).selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(names)])
    bench = spark.createDataFrame([(1, " ".join(words(20)))], "item_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    for out in (line_dedup.line_dedup(docs, counts=False), ngram_join.keep_one(docs), substring_dedup.cut_repeats(docs, spans), decontaminate.decontaminate(docs, bench)):
        assert out.columns == docs.columns
        assert all(r[n] == k for r in out.collect() for k, n in enumerate(names))


def test_line_dedup_of_messy_rows_and_of_nothing(messy, nothing):
    check_lines(messy)
    assert line_dedup.line_dedup(nothing).collect() == []


def test_lines_of_rows_without_ids_or_with_the_same_id_are_told_apart(docs_of, words):
    line = lambda n: " ".join(words(n))
    stock, near, other = line(6), words(12), line(5)
    own = [line(9) for _ in range(8)]
    texts = [
        "\n".join([own[0], own[1], stock]),
        "\n".join([own[2], own[3], stock]),
        "\n".join([own[4], " ".join(near), own[5], other]),
        "\n".join([own[6], " ".join([*near[:-1], "changed"]), own[7], other]),
        other,
    ]
    rows = line_dedup.line_dedup(docs_of(texts, ids=[None, None, 4, 4, None])).collect()
    left = [x for r in rows for x in r["text"].split("\n") if x]
    assert all(left.count(x) == 1 for x in [*own, stock, other])
    assert len(left) == len(own) + 3
    assert sum(r["n_removed"] for r in rows) == 4


def brute_leaks(docs, items):
    out = set()
    for i, t in docs:
        w = (t or "").lower()
        w = WORD.findall(w)
        for j, x in items:
            v = WORD.findall((x or "").lower())
            if len(v) < 5:
                if v and v in [WORD.findall(x) for x in (t or "").lower().split("\n")]:
                    out.add((i, j))
                continue
            width = min(13, len(v))
            allowed = width * 2 // 13
            for d in range(-len(v), len(w)):
                same = [0 <= d + k < len(w) and w[d + k] == v[k] for k in range(len(v))]
                if max(sum(same[k : k + width]) for k in range(len(v) - width + 1)) >= width - allowed:
                    out.add((i, j))
    return out


def test_decontamination_matches_brute_force(spark, docs_of, words, rng, messy, nothing):
    items = [words(n) for n in (3, 5, 6, 7, 12, 13, 14, 30, 60)]
    texts = []
    for v in items:
        for edits in (0, 1, 2, 3, 6):
            new = list(v)
            for k in rng.sample(range(len(v)), min(edits, len(v))):
                new[k] = "zzz"
            texts.append(" ".join([*words(rng.randint(0, 30)), *new, *words(rng.randint(0, 30))]))
        texts.append(" ".join(v[: len(v) // 2]))
        texts.append(" ".join(v[len(v) // 3 :]).upper())
    texts += [" ".join(words(50)) for _ in range(10)]
    texts += ["first line\n" + " ".join(items[0]).upper() + "  \nlast", " ".join([*items[0], "more"])]
    bench = spark.createDataFrame([*enumerate(" ".join(v) for v in items), (50, None), (51, ""), (52, "of the")], "item_id long, text string")
    docs = docs_of(texts)
    rows = decontaminate.overlaps(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == brute_leaks(list(enumerate(texts)), list(enumerate(" ".join(v) for v in items)))
    assert len(rows) == len(got) > 20
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in got}
    assert decontaminate.overlaps(messy, bench).collect() == []
    assert decontaminate.decontaminate(messy, bench).count() == messy.count()
    assert {(r["doc_id"], r["first_word"]) for r in rows if r["item_id"] == 0} >= {(len(texts) - 2, 2)}
    assert decontaminate.overlaps(nothing, bench).collect() == []
    assert decontaminate.overlaps(docs, bench.limit(0)).collect() == []
    assert decontaminate.overlaps(docs, messy).count() >= 0


def test_passages_in_rows_without_ids_or_with_the_same_id_are_leaks(spark, docs_of, words):
    items = [words(20), words(30)]
    bench = spark.createDataFrame([(1, " ".join(items[0])), (None, " ".join(items[1]))], "item_id long, text string")
    texts = [" ".join([*words(15), *more, *words(15)]) for more in (items[0], [], items[1], items[0], [], [])]
    docs = docs_of(texts, ids=[None, None, 3, 4, 4, 5])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(None, 1), (3, None), (4, 1)}
    assert {r["text"] for r in decontaminate.decontaminate(docs, bench).collect()} == {texts[1], texts[4], texts[5]}


def test_main_path_of_decontamination_runs_no_python(spark, docs_of):
    plan = decontaminate.overlaps(docs_of(["a b c d e f"]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())


def test_repeated_passages_are_found_and_clean_texts_left_alone(docs_of, words, rng, messy, nothing):
    passages = [words(n) for n in (55, 80, 300)]
    texts, holders = [], set()
    for p in passages:
        for _ in range(4):
            holders.add(len(texts))
            texts.append(" ".join([*words(rng.randint(0, 90)), *p, *words(rng.randint(0, 90))]))
    texts += [" ".join(words(150)) for _ in range(30)]
    short = words(15)
    texts += [" ".join([*words(60), *short, *words(60)]) for _ in range(5)]
    docs = docs_of(texts)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == holders
    for r in spans:
        part = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
        p = next(" ".join(x) for k, x in enumerate(passages) if k == r["doc_id"] // 4)
        assert part in p and len(part) > 0.4 * len(p)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(docs, substring_dedup.repeated_spans(docs)).collect()}
    assert len(cut) == len(texts)
    assert all(cut[i] == t for i, t in enumerate(texts) if i not in holders)
    assert sum(len(cut[i]) < len(texts[i]) for i in holders) == 9
    assert {r["doc_id"] for r in substring_dedup.repeated_spans(messy).collect()} == set()
    assert substring_dedup.repeated_spans(nothing).collect() == []


def test_passages_of_rows_without_ids_or_with_the_same_id_are_found(docs_of, words):
    a, b = words(90), words(90)
    texts = [" ".join([*words(n), *p, *words(n)]) for n, p in ((40, a), (55, a), (70, a), (40, b), (60, b), (30, words(50)))]
    docs = docs_of(texts, ids=[None, None, None, 5, 5, None])
    spans = substring_dedup.repeated_spans(docs)
    rows = spans.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [5, 5, None, None, None]
    assert all(r["n_words"] > 60 for r in rows)
    cut = [r["text"] for r in substring_dedup.cut_repeats(docs, spans).collect()]
    middle = lambda p: sum(" ".join(p[20:-20]) in t for t in cut)
    assert len(cut) == 6 and middle(a) == middle(b) == 1
    assert len(set(cut) & set(texts)) == 3


def brute_spans(rows):
    """doc_id, start_byte, end_byte, n_chunks, n_words, first_doc_id by the definition of chunks, byte by byte."""
    table, radius = substring_dedup._TABLE.tolist(), substring_dedup.RADIUS
    spread = lambda h: ((h * 0x9E3779B1) ^ (h >> 7)) & 0xFFFFFFFF
    chunks = []
    for r, (i, t) in enumerate(rows):
        data = (t or "").encode()
        pad = bytes(32)
        full = pad + data + pad
        h = [spread(sum(table[full[k - j]] << j for j in range(min(8, k + 1))) & 0xFFFFFFFF) for k in range(len(full))]
        peak = lambda k: all(h[k] > x for x in h[k - radius : k]) and all(h[k] >= x for x in h[k + 1 : k + radius + 1])
        edges = sorted({0, len(data), *(k + 1 for k in range(len(data)) if peak(k + 32))})
        edges = sorted({*edges, *(x for a, b in zip(edges, edges[1:]) if b - a > 512 for x in range(a + 512, b, 512))})
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        chunks.append([(data[a:b], a, b, sum(a <= x < b for x in starts)) for a, b in zip(edges, edges[1:])])
    holders = defaultdict(set)
    for (i, _), found in zip(rows, chunks, strict=True):
        for piece, *_ in found:
            holders[piece].add(i)
    out = []
    for (i, _), found in zip(rows, chunks, strict=True):
        run = []
        for c in [*found, None]:
            if c is not None and len(holders[c[0]]) > 1:
                run.append(c)
                continue
            if sum(x[3] for x in run) >= substring_dedup.MIN_WORDS:
                out.append((i, run[0][1], run[-1][2], len(run), sum(x[3] for x in run), min(min(holders[x[0]]) for x in run)))
            run = []
    return sorted(out)


def test_spans_match_brute_force(docs_of, words, rng):
    passages = [words(n) for n in (30, 55, 120)]
    texts = [" ".join([*words(rng.randint(0, 60)), *rng.choice(passages), *words(rng.randint(0, 60))]) for _ in range(25)]
    texts += ["x" * 3000 + " " + " ".join(passages[1]), "y " + "x" * 3000 + " " + " ".join(passages[1]), "ünd " * 50, "ünd " * 50, ""]
    rows = list(enumerate(texts))
    names = ("doc_id", "start_byte", "end_byte", "n_chunks", "n_words", "first_doc_id")
    got = sorted(tuple(r[n] for n in names) for r in substring_dedup.repeated_spans(docs_of(texts)).collect())
    assert got == brute_spans(rows) and len(got) > 20


def test_chunks_cover_texts_and_resist_insertions(words):
    text = " ".join(words(3000))
    other = text[:5000] + "inserted here" + text[5000:]
    pieces = []
    for t in (text, other, "z" * 5000):
        data = np.frombuffer(t.encode(), np.uint8)
        start, end = substring_dedup.cuts(data, np.array([0, len(data)]))
        assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all()
        assert (end - start).max() <= substring_dedup.LONGEST
        pieces.append([t[a:b] for a, b in zip(start, end, strict=True)])
    assert len(set(pieces[0]) ^ set(pieces[1])) <= 10
    # a row's chunks don't depend on the rows beside it
    both = np.frombuffer((other + text).encode(), np.uint8)
    start, end = substring_dedup.cuts(both, np.array([0, len(other.encode()), len(both)]))
    assert len(start) == len(pieces[0]) + len(pieces[1])
