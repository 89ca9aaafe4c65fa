"""Catalog queries: filters over tables of resources, composed as column conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo, text
from terrane.operators.filters import limited


def time_filter(column: str, t0: str | None, t1: str | None) -> Column:
    out = F.lit(True)
    if t0 is not None:
        out = out & (F.col(column) >= F.lit(t0).cast("timestamp_ntz"))
    if t1 is not None:
        out = out & (F.col(column) <= F.lit(t1).cast("timestamp_ntz"))
    return out


def number_filter(column: str, least: float | None = None, most: float | None = None, equal: float | None = None) -> Column:
    """0 is a bound like any other."""
    out = F.lit(True)
    for value, test in ((least, F.col(column) >= F.lit(least)), (most, F.col(column) <= F.lit(most)), (equal, F.col(column) == F.lit(equal))):
        if value is not None:
            out = out & test
    return out


def name_filter(column: str, name: str | None) -> Column:
    return F.lit(True) if name is None else text.name_like(F.col(column), name)


def polygon_filter(lon: str, lat: str, ring: geo.Ring | None) -> Column:
    return F.lit(True) if ring is None else geo.in_polygon(F.col(lon), F.col(lat), ring)


def radius_filter(lon: str, lat: str, centre: tuple[float, float] | None, distance: float, unit: str = "km") -> Column:
    if centre is None:
        return F.lit(True)
    metres = distance * {"km": 1000.0, "mi": geo.METRES_PER_MILE}[unit]
    return geo.haversine(F.col(lon), F.col(lat), F.lit(float(centre[0])), F.lit(float(centre[1]))) <= metres


def search(catalog: DataFrame, conditions: list[Column], most: int | None = None) -> DataFrame:
    """Rows that meet all conditions; more than `most` of them raise."""
    for c in conditions:
        catalog = catalog.where(c)
    return catalog if most is None else limited(catalog, most)


def lake_granules(lakes: DataFrame, ids: DataFrame, refid: int | None = None, name: str | None = None, coord: tuple[float, float] | None = None, t0: str | None = None, t1: str | None = None) -> DataFrame:
    """Granules over the lakes that match; lakes (refid, lake_name, x0, y0, x1, y1, granules array<int>), ids (ids, granule, begin_time)."""
    picked = lakes
    if refid is not None:
        picked = picked.where(F.col("refid") == refid)
    if name is not None:
        picked = picked.where(text.name_like(F.col("lake_name"), name))
    if coord is not None:
        picked = picked.where((F.col("x0") <= coord[0]) & (F.col("x1") >= coord[0]) & (F.col("y0") <= coord[1]) & (F.col("y1") >= coord[1]))
    found = picked.select(F.explode("granules").alias("ids")).distinct().join(ids, "ids")
    return found.where(time_filter("begin_time", t0, t1)).select("granule").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Granules in both lists."""
    return a.intersect(b)
