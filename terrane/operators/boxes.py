"""Spatial index arithmetic on boxes (x0, y0, x1, y1), and catalogs of boxes that are compared where they were projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo

Box = tuple[float, float, float, float]
NAMES = ("x0", "y0", "x1", "y1")


def project(box: Box, kind: str) -> Box:
    """The planar box of a box of degrees: of its two given corners."""
    (ax, ay), (bx, by) = geo.project_point(box[0], box[1], kind), geo.project_point(box[2], box[3], kind)
    return min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)


def projected(df: DataFrame, box: tuple[str, str, str, str], kind: str) -> DataFrame:
    """df with x0, y0, x1, y1 of its boxes of degrees (lon, lat, lon, lat)."""
    ax, ay = geo.project(F.col(box[0]), F.col(box[1]), kind)
    bx, by = geo.project(F.col(box[2]), F.col(box[3]), kind)
    return df.withColumns({"x0": F.least(ax, bx), "y0": F.least(ay, by), "x1": F.greatest(ax, bx), "y1": F.greatest(ay, by)})


def touches(box: Box) -> Column:
    """Whether a row's planar box and this one share a point."""
    return (F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1])


def query(catalog: DataFrame, box: tuple[str, str, str, str], wanted: Box, kind: str) -> DataFrame:
    """Rows of a catalog whose box overlaps the wanted one, both in the projected plane."""
    return projected(catalog, box, kind).where(touches(project(wanted, kind))).drop(*NAMES)


def intersect(a: Box, b: Box) -> Box | None:
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out if out[0] <= out[2] and out[1] <= out[3] else None


def combine(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def split(box: Box) -> tuple[Box, Box]:
    """Two halves, across the longer side."""
    x0, y0, x1, y1 = box
    if x1 - x0 >= y1 - y0:
        m = (x0 + x1) / 2
        return (x0, y0, m, y1), (m, y0, x1, y1)
    m = (y0 + y1) / 2
    return (x0, y0, x1, m), (x0, m, x1, y1)


def hull(df: DataFrame, x: str, y: str) -> Box:
    """The box around all points, from partial minima: what limits which rasters are looked at."""
    return tuple(df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())


def lookup(df: DataFrame, key: str, value: object, how: str = "exact") -> DataFrame:
    """The row at a key, at or after it, at or before it, after it, or before it: one row, found without a sort of the table."""
    k = F.col(key)
    test, ascending = {"exact": (k == value, True), "at_or_after": (k >= value, True), "at_or_before": (k <= value, False), "after": (k > value, True), "before": (k < value, False)}[how]
    return df.where(test).orderBy(k.asc() if ascending else k.desc()).limit(1)
