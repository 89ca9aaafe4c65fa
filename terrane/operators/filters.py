"""Row filters of tracks and catalogs. Each takes a DataFrame or columns and adds conditions only, so scans can use them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo


def levels(given: int | Iterable[int], all_levels: Iterable[int]) -> list[int]:
    """A single level means that level or a higher one; a list means exactly its members. Unknown levels raise."""
    known = sorted(all_levels)
    wanted = [x for x in known if x >= given] if isinstance(given, int) else sorted(set(given))
    if isinstance(given, int) and given not in known or not set(wanted) <= set(known):
        raise ValueError(f"{given} is not among the levels {known}")
    return wanted


def confidence(columns: list[Column], wanted: list[int], surface: int | None = None) -> Column:
    """Whether the confidence of the chosen surface type, or the highest of all, is wanted."""
    level = F.greatest(*columns) if surface is None and len(columns) > 1 else columns[surface or 0]
    return level.isin(wanted)


def member(value: Column, wanted: Iterable[object], allowed: Iterable[object] | None = None) -> Column:
    """Membership; with `allowed`, a value outside of it raises."""
    hit = value.isin(list(wanted))
    if allowed is None:
        return hit
    return F.when(value.isin(list(allowed)), hit).otherwise(F.raise_error(F.concat(F.lit("value out of range: "), value.cast("string"))).cast("boolean"))


def flags_clear(flags: Column, mask: int) -> Column:
    """Rows with none of the mask's bits in a packed flag byte."""
    return flags.bitwiseAND(mask) == 0


#: A mask is made on the driver, so its size is bounded.
MOST_CELLS = 4_000_000


def polygon(df: DataFrame, lon: str, lat: str, ring: geo.Ring) -> DataFrame:
    return df.where(geo.in_polygon(F.col(lon), F.col(lat), ring))


def decode_mask(bits: str, rows: int, cols: int) -> list[tuple[int, int]]:
    """Cells that are on in a base-16 bitmap, eight cells to a byte, highest bit first, row by row."""
    data = bytes.fromhex(bits)
    if len(data) * 8 < rows * cols:
        raise ValueError("bitmap is too short")
    return [divmod(k, cols) for k in range(rows * cols) if data[k >> 3] >> (7 - (k & 7)) & 1]


def region_mask(df: DataFrame, lon: str, lat: str, on: list[tuple[int, int]], lon_min: float, lat_min: float, lon_max: float, lat_max: float, size: float) -> DataFrame:
    """Rows in a cell that is on; row 0 is at lat_max, column 0 at lon_min. The mask is a parameter of the request, so it is joined as a broadcast table only below 1 million cells."""
    spark = df.sparkSession
    cells = spark.createDataFrame(on, "mask_row int, mask_col int")
    inside = df.where(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))
    row, col = F.floor((lat_max - F.col(lat)) / size).cast("int"), F.floor((F.col(lon) - lon_min) / size).cast("int")
    keyed = inside.withColumn("mask_row", row).withColumn("mask_col", col)
    return keyed.join(F.broadcast(cells) if len(on) < 1_000_000 else cells, ["mask_row", "mask_col"], "left_semi").drop("mask_row", "mask_col")


def in_region_mask(df: DataFrame, lon: str, lat: str, on: list[tuple[int, int]], lon_min: float, lat_min: float, lon_max: float, lat_max: float, size: float, name: str) -> DataFrame:
    """df with a boolean column `name`: whether a row is in a cell that is on. Rows without a place are not."""
    cells = df.sparkSession.createDataFrame(on, "mask_row int, mask_col int").withColumn(name, F.lit(True))
    within = F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max)
    row, col = F.floor((lat_max - F.col(lat)) / size).cast("int"), F.floor((F.col(lon) - lon_min) / size).cast("int")
    keyed = df.withColumn("mask_row", F.when(within, row)).withColumn("mask_col", F.when(within, col))
    found = keyed.join(F.broadcast(cells) if len(on) < 1_000_000 else cells, ["mask_row", "mask_col"], "left")
    return found.withColumn(name, F.coalesce(name, F.lit(False))).drop("mask_row", "mask_col")


def rasterise(ring: geo.Ring, size: float) -> tuple[list[tuple[int, int]], float, float, float, float]:
    """Cells of a polygon's bounding box whose centre is inside, and the box."""
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    lon0, lat0, lon1, lat1 = min(lons), min(lats), max(lons), max(lats)
    rows, cols = int((lat1 - lat0) / size) + 1, int((lon1 - lon0) / size) + 1

    if rows * cols > MOST_CELLS:
        raise ValueError(f"a mask of {rows} x {cols} cells is too fine; {MOST_CELLS} cells are the most")
    x, y = lon0 + (np.arange(cols) + 0.5) * size, lat1 - (np.arange(rows)[:, None] + 0.5) * size
    hit = np.zeros((rows, cols), bool)
    for (xi, yi), (xj, yj) in zip(ring, [*ring[-1:], *ring[:-1]], strict=True):
        if yi != yj:
            hit ^= ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
    on = [(r, c) for r, c in np.argwhere(hit).tolist()]
    return on, lon0, lat0, lon1, lat1


def contiguous_extent(df: DataFrame, track: list[str], order: list[str], inside: Column, counts: Column | None = None) -> DataFrame:
    """Of each track, the rows from the first one inside to the first one outside after it; later re-entries are dropped.

    counts: rows with a count of 0 neither start nor end an extent.
    """
    live = F.lit(True) if counts is None else counts > 0
    whole = Window.partitionBy(*track)
    at = F.row_number().over(whole.orderBy(*order))
    marked = df.withColumn("_at", at).withColumn("_in", F.when(live, inside)).withColumn("_first", F.min(F.when(F.col("_in"), F.col("_at"))).over(whole))
    marked = marked.withColumn("_stop", F.min(F.when(~F.col("_in") & (F.col("_at") > F.col("_first")), F.col("_at"))).over(whole))
    return marked.where((F.col("_at") >= F.col("_first")) & (F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))).drop("_at", "_in", "_first", "_stop")


def mask_extent(df: DataFrame, inside: Column) -> DataFrame:
    """Every row inside, re-entries too."""
    return df.where(inside)


def index_range(df: DataFrame, track: list[str], order: list[str], wanted: Column) -> DataFrame:
    """Of each track, the rows from the first to the last wanted one, with what lies between."""
    whole = Window.partitionBy(*track)
    marked = df.withColumn("_at", F.row_number().over(whole.orderBy(*order))).withColumn("_hit", F.when(wanted, F.col("_at")))
    marked = marked.withColumn("_lo", F.min("_hit").over(whole)).withColumn("_hi", F.max("_hit").over(whole))
    return marked.where(F.col("_at").between(F.col("_lo"), F.col("_hi"))).drop("_at", "_hit", "_lo", "_hi")


def radius(df: DataFrame, lon: str, lat: str, lon0: float, lat0: float, distance: float, unit: str = "km") -> DataFrame:
    metres = distance * {"km": 1000.0, "mi": geo.METRES_PER_MILE, "m": 1.0}[unit]
    return df.where(geo.haversine(F.col(lon), F.col(lat), F.lit(lon0), F.lit(lat0)) <= metres)


def limited(df: DataFrame, most: int) -> DataFrame:
    """df, or an error if it has more than `most` rows; only most + 1 of them are counted."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} resources; narrow the request or raise the limit")
    return df


def scaled_line(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of integers scaled by a million; longitudes are wrapped."""
    return geo.wrap_longitude(lon / 1e6), lat / 1e6
