"""Projections: computed columns, fill values, constants, indexes, fixed-length lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import text
from terrane.sources.scratch import checkpoint

FLOAT_FILL = 3.4028234663852886e38
INT_FILL = 2147483647


def without_fill(value: Column, kind: str) -> Column:
    """Fill values: the largest float becomes NaN, the largest int 0."""
    if kind in ("float", "double"):
        return F.when(value.cast("float") >= F.lit(FLOAT_FILL).cast("float"), F.lit(float("nan"))).otherwise(value)
    return F.when(value == INT_FILL, F.lit(0)).otherwise(value)


def fill_normalised(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: without_fill(F.col(c), k).cast(k) for c, k in kinds.items() if k in ("float", "double", "int")})


def along_track(distance: Column, segment: Column) -> Column:
    return distance + segment


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Metadata values as constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_index(df: DataFrame, name: str, order: list[str], track: list[str] | None = None) -> DataFrame:
    """0..n-1 in order, of each track, or of the whole table.

    The whole table is not sorted in one task: its rows are dealt to ranges, counted there, and numbered inside.
    The ranges are kept in a checkpoint, as dealing rows again could cut them elsewhere.
    """
    if track:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*track).orderBy(*order)).cast("long") - 1)
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_before")


def fixed_list(values: Column, n: int) -> Column:
    """A waveform of n samples, filled up with zeros."""
    return text.pad_list(values, n)


def projected(df: DataFrame, fields: list[str], always: list[str] = ()) -> DataFrame:
    """The listed columns, and those of `always` (times) whether listed or not, in the table's order."""
    unknown = set(fields) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select([c for c in df.columns if c in fields or c in always])
