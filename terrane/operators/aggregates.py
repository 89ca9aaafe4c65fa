"""Reductions: exact statistics, the op(field) language, dedup, single-sample reductions, band indices."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.columns import FLOAT_FILL

_CALL = re.compile(r"^(\w+)\((\w+)\)$")


def mean(value: Column, over_all_rows: bool = False) -> Column:
    """Mean of values that are no fill. over_all_rows divides by the number of rows, skipped ones included. 0 if there is none."""
    real = F.when(value < FLOAT_FILL, value)
    n = F.count(F.lit(1)) if over_all_rows else F.count(real)
    return F.coalesce(F.try_divide(F.sum(real), n), F.lit(0.0))


def median(value: Column) -> Column:
    """Exact; the middle two of an even number are averaged; 0 if there is none."""
    return F.coalesce(F.median(value), F.lit(0.0))


def mode(value: Column) -> Column:
    """Most frequent value, the smallest of equals; 0 if there is none."""
    return F.coalesce(F.mode(value, True).cast("double"), F.lit(0.0))


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


OPERATIONS = {"mean": mean, "median": median, "mode": mode, "sum": total}


def parse_field(spec: str) -> tuple[str, str]:
    """(operation, field) of `op(field)` or `field`; without or with an unknown operation it is the mean."""
    found = _CALL.match(spec)
    if not found:
        return "mean", spec
    return (found[1] if found[1] in OPERATIONS else "mean"), found[2]


def ancillary(df: DataFrame, specs: list[str]) -> dict[str, Column]:
    """Output name to aggregate of each spec, as doubles; list columns give NaN."""
    kinds, out = dict(df.dtypes), {}
    for spec in specs:
        op, field = parse_field(spec)
        if field not in kinds:
            raise ValueError(f"no such field: {field}")
        name = field if spec == field else f"{op}_{field}"
        value = F.max(F.lit(float("nan"))) if kinds[field].startswith("array") else OPERATIONS[op](F.col(field).cast("double"))
        out[name] = value.cast("double").alias(name)
    return out


def histogram(df: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """How often each value occurs after scaling and cutting off its fraction."""
    return df.groupBy((F.col(value) * scale).cast("long").alias("value")).agg(F.count("*").alias("count"))


def flattened(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Sum, mean and count over all elements of list columns, without exploding rows."""
    add = F.aggregate(F.col(value), F.lit(0.0), lambda a, x: a + x.cast("double"))
    part = df.withColumn("_sum", add).withColumn("_n", F.size(value))
    return part.groupBy(*keys).agg(F.sum("_sum").alias("sum"), F.sum("_n").cast("long").alias("count"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"))


def _ranked(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*columns).orderBy(*order)))


def dedup(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of each combination of columns (all, if none are named). Rows are combined before the shuffle, so a frequent combination is no burden."""
    first = df.select(F.struct("*").alias("_row"), *[F.col(c) for c in columns or df.columns]).groupBy(*(columns or df.columns))
    return first.agg(F.min_by("_row", F.struct(*[F.col("_row")[c] for c in order])).alias("_row")).select("_row.*")


def dedup_report(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The rows that dedup drops."""
    return _ranked(df, columns or df.columns, order).where("_rank > 1").drop("_rank")


def single_sample(values: str, how: str) -> Column:
    """One value of a list of samples; mean and median leave out those that are not finite, an even median is the upper middle."""
    v = F.col(values)
    finite = F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = F.size(finite)
    return {
        "first": F.get(v, F.lit(0)),
        "last": F.try_element_at(v, F.lit(-1)),
        "min": F.array_min(v),
        "max": F.array_max(v),
        "mean": F.when(n > 0, F.aggregate(finite, F.lit(0.0), lambda a, x: a + x) / n),
        "median": F.when(n > 0, F.get(F.array_sort(finite), F.floor(n / 2).cast("int"))),
    }[how]


def nearest_value(value: Column) -> Column:
    """Ancillary estimate without a suffix: the most frequent value, the smallest of equals."""
    return mode(value)


def masked_counts(df: DataFrame, keys: list[str], count: str, inside: Column, most: int) -> DataFrame:
    """Photons and segments, all and inside; counts outside 0..most are taken as 0 and counted as errors."""
    legal = F.col(count).between(0, most)
    n = F.when(legal, F.col(count)).otherwise(F.lit(0))
    sums = {"photons": F.sum(n), "segments": F.count("*"), "photons_inside": F.sum(F.when(inside, n).otherwise(0)), "segments_inside": F.count_if(inside), "errors": F.count_if(~legal)}
    return df.groupBy(*keys).agg(*[v.cast("long").alias(k) for k, v in sums.items()])


def resource_index(df: DataFrame, resource: str, order: str, time: str, lon: str, lat: str) -> DataFrame:
    """One row for each resource: times, and positions of its first and last row."""
    return df.groupBy(resource).agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.min_by(lat, order).alias("lat0"), F.min_by(lon, order).alias("lon0"), F.max_by(lat, order).alias("lat1"), F.max_by(lon, order).alias("lon1"))


def band_indices(df: DataFrame, keys: list[str], band: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """NDSI, NDVI and NDWI of rasters given as a row for each band; names: role (green, red, nir, swir) to band."""
    one = {role: F.max(F.when(F.col(band) == b, F.col(value))) for role, b in names.items()}
    wide = df.where(F.col(band).isin(list(names.values()))).groupBy(*keys).agg(*[v.alias(f"_{k}") for k, v in one.items()])
    ratio = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    return wide.select(*keys, ratio("_green", "_swir").alias("ndsi"), ratio("_nir", "_red").alias("ndvi"), ratio("_nir", "_swir").alias("ndwi"))
