"""Operator 10: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are whitespace-separated and lower-cased. A mask such as 11011 hashes the words under its ones and
ignores those under its zeros, so a seed still matches when an ignored word was substituted. Seeds of all
positions of all documents are joined with those of the benchmark. A hit fixes an alignment of an item with a
document; along it, an item is found if WINDOW consecutive item words (all, for a shorter item) have at most
SUBSTITUTIONS words that differ: 2 in 13, in proportion for shorter items. With the mask 11011 no such place
is lost: 13 words with 2 substitutions always hold either five equal words in a row or a substitution with two
equal words on either side, and so do 7 words with 1 and 5 words with none. An item of fewer words than the mask
is found where a whole line of a document has exactly its words.

Before each shuffle a filter of at most BUCKETS numbers is broadcast, the hashes of what the other side has, modulo BUCKETS: positions
whose seed can't be the benchmark's and texts without a hit stay where they are. Seeds that very many positions share
are spread over SALTS tasks.

Defined results: a null text has no words; items without words never match. Documents and items are told apart by a
key of id and text, so those without an id, or with the same id and other texts, are looked at each by itself; in the
pairs, all with the same id, or with none, are taken together. A very long text is one row in one task. Empty tables give no pairs,
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import HEAVY, LEAST_HOT, row_key, table

MASKS = ("11011",)
WINDOW = 13
SUBSTITUTIONS = 2
BUCKETS = 1 << 20
SALTS = 64
_BETWEEN = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """(number of the mask, then by position) arrays of seeds, one array for each mask."""

    def of(number: int, mask: str) -> Column:
        at = [k for k, bit in enumerate(mask) if bit == "1"]
        places = F.when(F.size(words) >= len(mask), F.sequence(F.lit(0), F.size(words) - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(number), *[F.get(words, i + k) for k in at]))

    return F.array(*[of(n, m) for n, m in enumerate(masks)])


def _placed(df: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, place, seed of all positions."""
    out = df.withColumn("seeds", _seeds(F.col("words"), masks))
    if len(masks) == 1:
        return out.select(*keys, F.posexplode(F.col("seeds")[0]).alias("place", "seed"))
    return out.select(*keys, F.explode("seeds").alias("seeds")).select(*keys, F.posexplode("seeds").alias("place", "seed"))


def _bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int").alias("bucket")


def _likely(df: DataFrame, hash_: Column, wanted: DataFrame, of: Column) -> DataFrame:
    """Rows of df whose hash may be among those of wanted: at most BUCKETS whole numbers are broadcast."""
    return df.withColumn("bucket", _bucket(hash_)).join(F.broadcast(wanted.select(_bucket(of)).distinct()), "bucket", "left_semi").drop("bucket")


def _hits(texts: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """row, item, first_word of all alignments that a seed fixes."""
    seeds = _placed(items, ["item"], masks).select("seed", "item", F.col("place").alias("item_place"))
    found = _placed(texts.select("row", _words(F.col("text")).alias("words")), ["row"], masks)
    found = table(_likely(found, F.col("seed"), seeds, F.col("seed")))
    # fewer than HEAVY seeds can each have more than a share of 1 / HEAVY
    hot = table(found.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > max(found.count() // HEAVY, LEAST_HOT)).select("seed", F.lit(True).alias("hot")))
    some = found.join(F.broadcast(hot), "seed", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int")).otherwise(0))
    every = seeds.join(F.broadcast(hot), "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))))
    return some.join(every.drop("hot"), ["seed", "salt"]).select("row", "item", (F.col("place") - F.col("item_place")).alias("first_word")).distinct()


def _whole_lines(texts: DataFrame, items: DataFrame) -> DataFrame:
    """row, item, first_word of the lines that have exactly an item's words."""
    same = lambda words: F.xxhash64(F.array_join(words, " "))
    lines = texts.select("row", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _words).alias("lines"))
    lines = lines.select("row", "lines", F.posexplode("lines").alias("number", "words")).where(F.size("words") > 0).withColumn("line", same(F.col("words")))
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("number")), F.lit(0), lambda n, words: n + F.size(words))
    found = _likely(lines, F.col("line"), items, same(F.col("words"))).select("row", "words", "line", before.alias("first_word"))
    # texts of equal lines meet the few items first, so one very common line is not sent to one task
    found = found.groupBy("row", "line", "words", "first_word").agg(F.lit(0).alias("salt")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    wanted = items.select("item", F.col("words").alias("item_words"), same(F.col("words")).alias("line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.join(wanted, ["line", "salt"]).where(F.col("words") == F.col("item_words")).select("row", "item", "first_word").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """doc_id, item_id, first_word, item_words, equal_words, best_window of every benchmark item found in a document."""
    kept = _found(docs, benchmark, masks, window, substitutions)
    choice = F.max(F.struct("equal_words", "best_window", (-F.col("first_word")).cast("long").alias("back"), "item_words")).alias("b")
    return kept.groupBy("doc_id", "item_id").agg(choice).select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.item_words").alias("item_words"), F.col("b.equal_words").alias("equal_words"), F.col("b.best_window").alias("best_window"))


def _found(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], window: int, substitutions: int) -> DataFrame:
    """row (the row key), doc_id, item_id, first_word, item_words, equal_words, best_window of every alignment that counts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = table(items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]))
    least = min(map(len, masks))
    hits = _hits(texts, items.where(F.size("words") >= least), masks)
    short = items.where(F.size("words") < least)
    if short.limit(1).count():
        hits = hits.unionByName(_whole_lines(texts, short))
    hits = table(hits)
    near = _likely(texts, F.xxhash64("row"), hits, F.xxhash64("row")).dropDuplicates(["row"])
    aligned = near.join(hits, "row").withColumn("doc_words", _words(F.col("text"))).drop("text").join(items, "item")
    n = F.size("words")
    same = F.transform("words", lambda w, i: F.coalesce((F.when(i + F.col("first_word") >= 0, F.get("doc_words", i + F.col("first_word"))) == w).cast("int"), F.lit(0)))
    width = F.least(n, F.lit(window))
    checked = aligned.select("row", "doc_id", "item_id", "first_word", n.cast("long").alias("item_words"), same.alias("same"), width.alias("width"))
    add = lambda a, b: a + b
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("width")), F.lit(0), add)))
    checked = checked.withColumn("best_window", best.cast("long")).withColumn("equal_words", F.aggregate("same", F.lit(0), add).cast("long"))
    allowed = F.floor(F.col("width") * substitutions / F.lit(window))
    return checked.where(F.col("best_window") >= F.col("width") - allowed)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item is found. Columns stay, whatever their names."""
    marked = table(_found(docs, benchmark, MASKS, WINDOW, SUBSTITUTIONS).select("row").distinct())
    whole = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).withColumn("bucket", _bucket(F.xxhash64("row")))
    buckets = F.broadcast(marked.select(_bucket(F.xxhash64("row"))).distinct())
    clean = whole.join(buckets, "bucket", "left_anti").select("doc")
    return clean.unionByName(whole.join(buckets, "bucket", "left_semi").join(marked, "row", "left_anti").select("doc")).select("doc.*")
