import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None, sources=None):
    """documents of the given texts."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda *a, **k: table(spark, *a, **k)


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def words(rng):
    """Texts of n random words."""
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    return lambda n: [rng.choice(stock) for _ in range(n)]


@pytest.fixture
def messy(spark, words):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows, extra columns with common names."""
    long = " ".join(words(120_000))
    unbroken = "x" * 400_000
    texts = ["Hello there, general text of no great length.", "", None, " \t\n ", long, unbroken, "Ünïcode ünd mehr \U0001f600", "a\n\n\nb\n", "same text", "same text", "SAME text", "<|endoftext|>", "\n".join(["one line of words that is repeated"] * 3)]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[8], (None, "an id is missing here", "en", "s1", 21), (None, None, None, None, None)]
    extra = {"node": 1, "key": 2, "print": 3, "token": 4, "line": 5, "words": 6, "root": 7, "size": 8, "target": 9, "label": 10, "stats": 11, "place": 12, "item_id": 13, "group_size": 14, "bucket": 15, "of": 16, "c": 17, "rid": 18, "keys": 19, "n_lines": 20, "seed": 21, "quality": 22, "fold": 23, "wanted": 24, "held_out": 25, "raw": 26}
    schema = SCHEMA + "".join(f", {k} long" for k in extra)
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
