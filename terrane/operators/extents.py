"""Windows along a track: sliding by distance, anchored in the data, of a fixed number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD_TOO_SHORT, TOO_FEW = 0x1, 0x2


def sliding(df: DataFrame, track: list[str], x: str, length: float, step: float) -> DataFrame:
    """A row for each window that holds a row: `extent` k covers [x0 + k * step, x0 + k * step + length), x0 being the track's first x."""
    d = F.col(x) - F.min(x).over(Window.partitionBy(*track))
    out = df.withColumn("_d", d).withColumn("_lo", F.greatest(F.lit(0), F.floor((F.col("_d") - length) / step) + 1).cast("long")).withColumn("_hi", F.floor(F.col("_d") / step).cast("long"))
    out = out.where(F.col("_lo") <= F.col("_hi")).withColumn("extent", F.explode(F.sequence("_lo", "_hi")))
    return out.drop("_d", "_lo", "_hi")


def flags(x: Column, least_rows: int, least_spread: float) -> Column:
    """Aggregate: bits for a spread or a number of rows that is too small."""
    short = F.when(F.max(x) - F.min(x) < least_spread, SPREAD_TOO_SHORT).otherwise(0)
    few = F.when(F.count(F.lit(1)) < least_rows, TOO_FEW).otherwise(0)
    return short.bitwiseOR(few).cast("int")


def summarise(windows: DataFrame, track: list[str], x: str, measures: list[Column], least_rows: int = 10, least_spread: float = 20.0, pass_invalid: bool = False) -> DataFrame:
    """Aggregates of each window, with its flags; flagged windows go unless asked for. Partial sums are made before the shuffle."""
    out = windows.groupBy(*track, "extent").agg(F.count(F.lit(1)).alias("n"), flags(F.col(x), least_rows, least_spread).alias("pflags"), *measures)
    return out if pass_invalid else out.where("pflags = 0")


def anchored_bounds(x: np.ndarray, length: float, step: float, one_more: bool = False) -> list[tuple[int, int]]:
    """First and past-last row of each window of sorted x. The next window starts at the first row at least `step` on.

    one_more: the first row past a window belongs to it too.
    """
    out, i = [], 0
    while i < len(x):
        j = int(np.searchsorted(x, x[i] + length, side="left"))
        out.append((i, min(j + one_more, len(x))))
        nxt = int(np.searchsorted(x, x[i] + step, side="left"))
        i = max(nxt, i + 1)
    return out


def anchored(df: DataFrame, track: list[str], x: str, length: float, step: float, one_more: bool = False) -> DataFrame:
    """track, extent, start, stop, n of the windows anchored in the data. Where a window starts depends on the one before it, so a track is one group."""
    keys = df.select(*track, F.col(x).cast("double").alias("_x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*track).schema) + ", extent long, start double, stop double, n long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        xs = np.sort(part["_x"].to_numpy())
        bounds = anchored_bounds(xs, length, step, one_more)
        out = pd.DataFrame({"extent": range(len(bounds)), "start": [xs[i] for i, _ in bounds], "stop": [xs[j - 1] for _, j in bounds], "n": [j - i for i, j in bounds]})
        for k in reversed(track):
            out.insert(0, k, part[k].iloc[0])
        return out

    return keys.groupBy(*track).applyInPandas(run, schema)


def fixed_count(df: DataFrame, track: list[str], order: list[str], n: int) -> DataFrame:
    """`extent` counts chunks of n rows of each track."""
    row = F.row_number().over(Window.partitionBy(*track).orderBy(*order))
    return df.withColumn("extent", F.floor((row - 1) / n).cast("long"))


def per_extent(df: DataFrame, track: list[str], fn, schema: str) -> DataFrame:
    """fn on the rows of each (track, extent) as pandas."""
    return df.groupBy(*track, "extent").applyInPandas(fn, schema)


def chunks(frame: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
    for k in range(0, len(frame), n):
        yield frame.iloc[k : k + n]
