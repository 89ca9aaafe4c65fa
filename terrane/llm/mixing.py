"""Operator 2: mixing sources to target weights.

Every document gets a hash-random key. Keys are sorted in ranges: documents of a source are dealt to
16 ** DIGITS key ranges, so even a source that holds a third of all rows is spread over as many groups. The
prefix sum of a document is the sum of the ranges before it, a window over one row for each range, plus the
sum of the smaller keys in its own range. Each source is cut at its exact budget; a budget beyond the
source's size repeats it in whole epochs first.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source of
size 0 gets target 0; a null doc_id is keyed as the empty string. Rows that repeat a doc_id count each by
themselves. An empty table gives an empty result, other columns change nothing and stay in the mix. Equal keys are ordered by
doc_id, then size, so reruns agree; rows alike in all three are interchangeable. A very long text is counted in one task.
The sources' own table is ordered in one task: it holds a row for each
source, not for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm._spark import table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
DIGITS = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with `target`: the budget is poured by weight, and no source goes above most * its size."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    every = Window.partitionBy(F.lit(0))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    out = out.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * left / open_weight)).select("source", "source_size", "target")


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, digits: int, seed: int, carried: list[Column]) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and what is carried, for every row of docs."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *carried)
    sized = table(sized.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits)))
    # a join key without nulls
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = sized.withColumn("of", of)
    ranges = sized.groupBy("of", "source", "bucket").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most).withColumn("of", of).drop("source")
    ahead = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("of", "bucket", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset")).join(goal, "of")
    inside = Window.partitionBy("of", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(ranges, ["of", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, digits: int = DIGITS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source)."""
    return _planned(docs, weights, share, most, digits, seed, []).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, digits: int = DIGITS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs and epoch (from 0), a row for each time that a document is used.

    Documents of which nothing is taken are left out. The one document of a source at which the budget ends is cut after its last
    word in the budget, its words joined by spaces, and n_chars, where there is one, is set anew. A column named epoch is replaced.
    """
    plan = _planned(docs, weights, share, most, digits, seed, [F.struct("*").alias("doc")]).where("taken > 0")
    used = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("epoch") * F.col("size")
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    new = {"text": F.when(left < F.col("size"), F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left < F.col("size"), F.length(new["text"]).cast("long")).otherwise(F.col("doc.n_chars"))
    return used.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns if c != "epoch"], F.col("epoch").cast("long").alias("epoch"))
