"""Operators 2, 3, 6 and 7."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import exact_dedup, license_scan, mixing, token_count

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), k == stays, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(messy):
    got = sorted(map(tuple, exact_dedup.exact_dedup(messy).collect()), key=str)
    assert got == brute_copies([(r["doc_id"], r["text"]) for r in messy.collect()])


def test_exact_dedup_tells_texts_apart_that_share_a_fingerprint(docs_of):
    texts = ["abcd", "abce", "ABCD", "abce", "zzzz", "long " * 3000, "lang " * 3000, "long " * 3000]
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs_of(texts), bits=0).collect()), key=str)
    assert got == brute_copies(list(enumerate(texts)))


def test_exact_dedup_of_texts_cut_into_segments(docs_of, words):
    base = "ünd " * 5000
    texts = [base, base.upper().replace("Ü", "ü"), base[:-1], base[:9000] + "x" + base[9001:], "short", "SHORT", None, ""]
    ids = [1, 7, 3, 4, None, None, 9, 9]
    for bits in (62, 0):
        got = sorted(map(tuple, exact_dedup.exact_dedup(docs_of(texts, ids=ids), bits=bits, segment=8192).collect()), key=str)
        assert got == brute_copies(list(zip(ids, texts)))


def test_fingerprints_compose():
    data = np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8)
    whole = exact_dedup.fingerprint(data)
    for cut in (0, 1, 4095, 4096, 4097, 17_000, 30_000):
        assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])) == whole
    p, b = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    value = 0
    for x in data.tolist():
        value = (value * b + x + 1) % p
    assert value == whole[0]


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    goal = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]], abs=1e-6)
    for s, n in taken.items():
        assert n == int(goal[s] + 1e-9)


def test_mix_cuts_each_source_at_its_budget(docs_of, words, rng):
    texts = [" ".join(words(rng.randint(0, 60))) for _ in range(400)]
    sources = [rng.choice([None, "a", "b", "c", "d", "é", "hot", "hot", "hot", "hot"]) for _ in texts]
    docs = docs_of(texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts)
    check_mix(rows)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_of_messy_rows_and_of_nothing(messy, nothing):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count()
    check_mix(rows)
    assert mixing.mix(nothing).collect() == []


def test_token_counts_equal_the_library(messy, spark, sf_dir):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tricky = messy.select("doc_id", "text").union(spark.createDataFrame([(100, "<|endoftext|>a <|endoftext|>"), (101, "it's 12 we'LL　 \xa0 x  \n\n y  "), (102, "日本語テキスト" * 20), (103, "a" * 5000)], "doc_id long, text string"))
    docs = tricky.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    texts = [r["text"] or "" for r in docs.collect()]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = token_count.token_count(docs).collect()
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted((len(t.encode()), n, n > 512) for t, n in zip(texts, expected, strict=True))


def test_token_counts_of_nothing(nothing):
    assert token_count.token_count(nothing).collect() == []


def markup(template):
    """Nested lists: a word's alternatives, (lo, hi) of any words, or a list that may be missing."""
    stack = [[]]
    for part in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if part == "[[":
            stack.append([])
        elif part == "]]":
            inner = stack.pop()
            stack[-1].append(inner)
        elif part.startswith("{{"):
            stack[-1].append(tuple(map(int, part.strip("{}").split(":")[1].split("-"))))
        else:
            stack[-1].append(set(part.strip("()").split("|")))
    return stack[0]


def ends(tree, words, k):
    """All places at which the tree can end if it begins at word k."""
    places = {k}
    for part in tree:
        if isinstance(part, set):
            places = {p + 1 for p in places if p < len(words) and words[p] in part}
        elif isinstance(part, tuple):
            places = {p + n for p in places for n in range(part[0], part[1] + 1) if p + n <= len(words)}
        else:
            places |= {e for p in places for e in ends(part, words, p)}
    return places


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        at += found
        base |= {label} if found else set()
    accepted = lambda templates: {label for label, t in templates for tree in [markup(t)] if any(ends(tree, words, k) for k in range(len(words)))}
    full, notices = accepted(license_scan.LICENSES), accepted(license_scan.NOTICES)
    more = full | notices
    join = lambda x: ",".join(sorted(x))
    return len(words), len(at), min(at, default=None), max(at, default=None), join(base), join(base | more), 1.0 if full else 0.75 if notices else 0.5 if base else 0.0


def test_license_scan_matches_regular_expressions(docs_of, messy):
    texts = [
        "Released under the MIT License. Released under the MIT license",
        "This big work is released under the terms of the MIT license!",
        "under the MIT license",
        "Apache License, Version 2.0; licensed under the Apache License, Version 2.0",
        "This work is licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0 and CC-BY-SA",
        "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the GNU General Public License version 33",
        "Copyright (c) 2020 Some Holder of It. All rights reserved",
        "Copyright one two three four five six seven all rights reserved",
        "distributed under the BSD license, or the 3-clause: released under the 3-Clause BSD License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of cost, to any person obtaining a copy",
        "lİcensed under ünder the mit licenseé",
    ]
    for docs in (docs_of(texts), messy):
        got = sorted((tuple(r) for r in license_scan.license_scan(docs).collect()), key=str)
        assert got == sorted(((r["doc_id"], *brute_scan(r["text"])) for r in docs.collect()), key=str)


def test_whole_licenses_are_accepted_and_changed_ones_are_not(docs_of):
    expected, texts = [], []
    for label, template in license_scan.LICENSES:
        with_all = re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\w+:\d+-\d+\}\}", "Copyright-Holders", template))
        without = re.sub(r"\[\[[^\]]*\]\]", " ", re.sub(r"\{\{\w+:\d+-\d+\}\}", "author", template))
        words = without.split()
        changed = [*words[: len(words) * 3 // 4], "never", *words[len(words) * 3 // 4 :]]
        for text, ok in ((with_all.upper(), True), ("Intro. " + without + " The end.", True), (" ".join(changed), False), (" ".join(words[:-1]), False)):
            texts.append(text)
            expected.append((label, ok))
    rows = license_scan.license_scan(docs_of(texts)).orderBy("doc_id").collect()
    assert [(label in r["labels"].split(",") and r["score"] == 1, label) for r, (label, _) in zip(rows, expected)] == [(ok, label) for label, ok in expected]
    assert [tuple(r)[1:] for r in rows] == [brute_scan(t) for t in texts]


def test_license_scan_of_nothing(nothing):
    assert license_scan.license_scan(nothing).collect() == []
