"""Shared distributed steps: tables that cut lineage, joins on hot keys, keys of rows, connected components."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from terrane.llm import _bloom
from terrane.sources.scratch import checkpoint as checkpoint
from terrane.sources.scratch import discard as discard
from terrane.sources.scratch import table as table

ROOT = str(Path(__file__).resolve().parents[2])
#: A key with more than 1 / HEAVY of all rows is hot; there are fewer than HEAVY of them, so they can be broadcast.
HEAVY = 1000
LEAST_HOT = 1000
SALTS = 1 << 16


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":") if env.get("PYTHONPATH") else []
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    if ROOT not in sys.path:
        sys.path.append(ROOT)


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """left joined with right, which has one row for each key; right's `weight` is how many rows of left have the key.

    Keys with more than total / HEAVY rows, which are fewer than HEAVY, are broadcast; rows that have one are spread over
    the tasks of the shuffle that the other keys need, so no task gets all rows of a key. left is evaluated once.
    """
    hot = F.col(weight) > max(total // HEAVY, LEAST_HOT)
    payload = F.struct(*[c for c in right.columns if c not in keys])
    heavy = right.where(hot).select(*keys, payload.alias("_heavy"))
    # always 0, but not a constant that the optimizer would take out of the join's keys
    none = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    light = right.where(~hot).select(*keys, none.alias("_salt"), payload.alias("_light"))
    spread = F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    both = left.join(F.broadcast(heavy), keys, "left").withColumn("_salt", spread).join(light, [*keys, "_salt"], "left")
    found = F.coalesce("_heavy", "_light")
    if how == "inner":
        both = both.where(found.isNotNull())
    return both.select(*left.columns, *[found[c].alias(c) for c in right.columns if c not in keys])


def row_key() -> Column:
    """128 bits that tell rows (doc_id, text) apart; rows alike in both have the same key, and a null text counts as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose key is in rows (row). Only rows that a Bloom filter lets pass are joined; all columns travel in one, so no name of theirs matters."""
    ship(docs.sparkSession)
    bits = _bloom.build(rows.select(F.xxhash64("row").alias("hash")), "hash")

    @pandas_udf(BooleanType())
    def likely(key: pd.Series) -> pd.Series:
        return pd.Series(_bloom.maybe(bits, key.to_numpy(np.int64)))

    whole = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).withColumn("likely", likely(F.xxhash64("row")))
    kept = whole.where("likely").join(rows, "row", "left_anti")
    return whole.where("not likely").select("doc").unionByName(kept.select("doc")).select("doc.*")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) of one type that has an order; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which link the greater, then the lesser
    neighbours of every node to the smallest one and settle in O(log n ** 2) rounds for any graph. Minima are
    combined before the shuffle and hot nodes are split, so no task gets all edges of a node. Edges are kept as
    (u, v) with u > v; at the end u are the nodes and v their roots.
    """
    kept = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        n = kept.count()
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).withColumn("m", F.least("u", "m"))
        large = table(attach(both, least, ["u"], "w", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        discard(kept)
        n = large.count()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = attach(large, least, ["u"], "w", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(large)
        roots = kept.select("v").distinct()
        # done when every node has one root and no root has another
        if not kept.groupBy("u").count().where("count > 1").limit(1).count() and not roots.join(kept.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
