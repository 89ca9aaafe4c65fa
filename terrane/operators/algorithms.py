"""Along-track algorithms: line fits, surface percentiles, canopy metrics, density scores, water surface and refraction.

Those that are aggregates are column expressions; those that iterate over the rows of one window or track are
numpy kernels that get exactly that group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPEED_OF_LIGHT = 299792458.0
PULSE_RATE = 10000.0
SIGMA_BEAM = 4.25
SIGMA_PULSE = 0.68e-9
ROBUST_SCALE = 1.349
OUT_OF_BOUNDS, MAX_ITERATIONS, TOO_SHORT, TOO_FEW = 0x8, 0x4, 0x1, 0x2
GROUND, CANOPY, TOP_OF_CANOPY = 1, 2, 3
BIN_UNDERFLOW, BIN_OVERFLOW = 0x10, 0x20
MAX_BINS = 1000
PERCENTILES = tuple(range(5, 100, 5))


# --- surface fits


def single_pass_fit(x: Column, h: Column) -> list[Column]:
    """Least-squares line of a window as aggregates: slope, intercept and root mean square of the residuals."""
    slope, intercept, n = F.regr_slope(h, x), F.regr_intercept(h, x), F.regr_count(h, x)
    squares = F.regr_syy(h, x) - F.pow(F.regr_sxy(h, x), 2) / F.nullif(F.regr_sxx(h, x), F.lit(0.0))
    return [slope.alias("slope"), intercept.alias("intercept"), F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("rms")]


def _line(x: np.ndarray, h: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Intercept, slope, and the weights whose sum product with any quantity gives its value at x = 0."""
    n, s, ss = len(x), x.sum(), (x * x).sum()
    det = n * ss - s * s
    if det == 0:
        return float(h.mean()), 0.0, np.full(n, 1 / n)
    weights = (ss - s * x) / det
    return float(weights @ h), float(((n * x - s) / det) @ h), weights


def robust_fit(x: np.ndarray, h: np.ndarray, background: float = 0.0, h_min: float = 3.0, sigma_max: float = 5.0, rounds: int = 5, least_rows: int = 10, least_spread: float = 20.0) -> dict:
    """Iterative line fit: residuals are cut at a window that follows their robust spread, until nothing changes.

    x: distance from the window's centre; background: noise events per metre of height in the whole window.
    """
    keep, window, flag, done = np.arange(len(x)), math.inf, 0, 0
    while True:
        a, b, weights = _line(x[keep], h[keep])
        r = h[keep] - (a + b * x[keep])
        order = np.argsort(r, kind="stable")
        s, n = r[order], len(r)
        lo, hi = (float(s[0]), float(s[-1])) if math.isinf(window) else (-window / 2, window / 2)
        noise = background * (hi - lo) if math.isinf(window) else background * window
        rate, signal = (noise / (hi - lo) if hi > lo else 0.0), n - noise
        if signal <= 1:
            sigma = (hi - lo) / n
        else:
            i0, i1 = 0, n - 1
            while i0 < n - 1 and i0 + 1.5 < 0.25 * signal + (s[i0] - lo) * rate:
                i0 += 1
            while i1 > 0 and i1 - 0.5 > 0.75 * signal + (s[i1] - lo) * rate:
                i1 -= 1
            if i1 < i0:
                i0, i1 = int(n / 2 - signal / 4 + 0.5) - 1, int(n / 2 + signal / 4 + 0.5)
            if 0 <= i0 < n and 0 <= i1 < n:
                sigma = float(s[i1] - s[i0]) / ROBUST_SCALE
            else:
                flag |= OUT_OF_BOUNDS
                sigma = 0.0
        expected = math.sqrt((SPEED_OF_LIGHT / 2 * SIGMA_PULSE) ** 2 + SIGMA_BEAM**2 * b * b)
        fresh = max(h_min, 6 * expected, 6 * min(sigma, sigma_max))
        window = fresh if math.isinf(window) else max(fresh, 0.75 * window)
        inside = np.abs(r) < window / 2
        done += 1
        kept = keep[inside]
        if len(kept) < least_rows:
            flag |= TOO_FEW
            break
        if x[kept].max() - x[kept].min() < least_spread:
            flag |= TOO_SHORT
            break
        if len(kept) == n:
            break
        if done >= rounds:
            flag |= MAX_ITERATIONS
            break
        keep = kept
    rms = math.sqrt(float((r * r).mean()))
    return {"n": len(keep), "h_mean": a, "slope": b, "rms_misfit": rms, "h_sigma": rms * math.sqrt(float(weights @ weights)), "window_height": window, "pflags": flag, "keep": keep, "weights": weights}


FIT_SCHEMA = "extent long, n_fit_photons int, h_mean double, dh_fit_dx double, rms_misfit double, h_sigma double, w_surface_window_final double, x_atc double, pflags int"


def surface_fit(df: DataFrame, track: list[str], x: str, h: str, length: float = 40.0, step: float = 20.0, rate: str | None = None, velocity: float = 7000.0, pass_invalid: bool = False, **options) -> DataFrame:
    """Robust line fit of each sliding window of each track, whose rows are one group; rate: column of noise events per second.

    Windows are cut inside the group, so overlapping ones cost no copies of rows in the shuffle.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*track).schema}
    names = [*track, *(c.split()[0] for c in FIT_SCHEMA.split(", "))]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        xs, hs = part[x].to_numpy(float), part[h].to_numpy(float)
        order = np.lexsort((hs, xs))
        xs, hs = xs[order], hs[order]
        noise = part[rate].to_numpy(float)[order] * (length * PULSE_RATE / velocity / (SPEED_OF_LIGHT / 2)) if rate else None
        starts = xs[0] + np.arange(int((xs[-1] - xs[0]) // step) + 1) * step
        first, last = np.searchsorted(xs, starts), np.searchsorted(xs, starts + length)
        rows = []
        for k in np.flatnonzero(last > first).tolist():
            i, j, centre = first[k], last[k], starts[k] + length / 2
            found = robust_fit(xs[i:j] - centre, hs[i:j], float(noise[i]) if rate else 0.0, **options)
            if pass_invalid or not found["pflags"]:
                rows.append((k, found["n"], found["h_mean"], found["slope"], found["rms_misfit"], found["h_sigma"], found["window_height"], centre, found["pflags"]))
        out = pd.DataFrame(rows, columns=names[len(track) :])
        for n, c in enumerate(track):
            out.insert(n, c, part[c].iloc[0])
        return out

    needed = df.select(*track, x, h, *([rate] if rate else []))
    return needed.groupBy(*track).applyInPandas(fit, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", " + FIT_SCHEMA)


# --- surface blanket


def blanket(cls: Column, h: Column, least: int = 10, top: float = 0.98, ground: float = 0.5) -> list[Column]:
    """Top of surface and median ground of a window as exact percentiles, with fallbacks from the canopy's top to canopy to ground."""
    of = lambda *cs: F.when(cls.isin(*cs), h)
    enough = lambda c: F.count(c) >= least
    nan = F.lit(float("nan"))
    peaks, canopy, soil = of(TOP_OF_CANOPY), of(CANOPY, TOP_OF_CANOPY), of(GROUND)
    surface = F.when(enough(peaks), F.percentile(peaks, top)).when(enough(canopy), F.percentile(canopy, top)).when(enough(soil), F.percentile(soil, top)).otherwise(nan)
    floor = F.when(enough(soil), F.percentile(soil, ground)).otherwise(nan)
    missing = F.when(enough(peaks) | enough(canopy) | enough(soil), 0).otherwise(TOO_FEW).bitwiseOR(F.when(enough(soil), 0).otherwise(TOO_FEW))
    return [surface.alias("top_of_surface"), floor.alias("median_ground"), missing.cast("int").alias("surface_flags")]


# --- canopy metrics


_WANTED = np.array([*PERCENTILES, 98], float)


def canopy(relief: np.ndarray, cls: np.ndarray, height: np.ndarray, binsize: float = 1.0) -> dict:
    """Vegetation heights, their spread, cumulative-bin percentiles and the ground's median height."""
    veg = np.sort(relief[(cls == CANOPY) | (cls == TOP_OF_CANOPY)])
    soil = height[cls == GROUND]
    out = {"ground_photon_count": len(soil), "vegetation_photon_count": len(veg), "pflags": 0, "h_te_median": float(np.median(soil)) if len(soil) else math.nan}
    if not len(veg):
        return out | {"h_max_canopy": math.nan, "h_min_canopy": math.nan, "h_mean_canopy": math.nan, "canopy_openness": math.nan, "h_canopy": math.nan, "canopy_h_metrics": [math.nan] * len(PERCENTILES)}
    bins = math.ceil((veg[-1] - veg[0]) / binsize)
    if bins > MAX_BINS:
        out["pflags"] |= BIN_OVERFLOW
        bins = MAX_BINS
    elif bins <= 0:
        out["pflags"] |= BIN_UNDERFLOW
        bins = 1
    place = np.clip(np.floor((veg - veg[0]) / binsize).astype(int), 0, bins - 1)
    cumulative = np.cumsum(np.bincount(place, minlength=bins))
    heights = veg[cumulative[np.argmax(cumulative / len(veg) * 100 >= _WANTED[:, None], axis=1)] - 1].tolist()
    return out | {"h_max_canopy": float(veg[-1]), "h_min_canopy": float(veg[0]), "h_mean_canopy": float(veg.mean()), "canopy_openness": float(veg.std()), "h_canopy": heights[-1], "canopy_h_metrics": heights[:-1]}


CANOPY_SCHEMA = "extent long, x_atc double, ground_photon_count int, vegetation_photon_count int, h_te_median double, h_max_canopy double, h_min_canopy double, h_mean_canopy double, canopy_openness double, h_canopy double, canopy_h_metrics array<double>, pflags int"


def canopy_metrics(df: DataFrame, track: list[str], x: str, relief: str, cls: str, height: str, length: float = 40.0, step: float = 20.0, binsize: float = 1.0, geolocation: str = "median", one_more: bool = False) -> DataFrame:
    """Canopy metrics of windows anchored in the data. A window's place is the mean, the middle row's or the centre of its x."""
    from terrane.operators.extents import anchored_bounds

    place = {"mean": np.mean, "median": np.median, "center": lambda v: (v.min() + v.max()) / 2}[geolocation]
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*track).schema}
    names = [c.split()[0] for c in CANOPY_SCHEMA.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((part[relief].to_numpy(float), part[x].to_numpy(float)))
        xs, reliefs, heights = (part[c].to_numpy(float)[order] for c in (x, relief, height))
        classes = part[cls].to_numpy()[order]
        bounds = list(anchored_bounds(xs, length, step, one_more))
        found = [canopy(reliefs[i:j], classes[i:j], heights[i:j], binsize) for i, j in bounds]
        out = pd.DataFrame(found, columns=[n for n in names if n not in ("extent", "x_atc")])
        out["extent"], out["x_atc"] = range(len(bounds)), [float(place(xs[i:j])) for i, j in bounds]
        for c in track:
            out[c] = part[c].iloc[0]
        return out[[*track, *names]]

    return df.groupBy(*track).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", " + CANOPY_SCHEMA)


# --- density score


def density_score(df: DataFrame, track: list[str], segment: str, x: str, h: str, order: list[str], win_x: float = 15.0, win_h: float = 6.0, least: int = 5, scale: float = 1000.0) -> DataFrame:
    """df with `score` 0 to 255: how near the nearest neighbours of a row are in height.

    Neighbours lie within half a window of x and of h. x is scaled to whole numbers for the range frame, with
    1 / scale as its resolution, and compared exactly afterwards.
    """
    half_x, half_h = win_x / 2, win_h / 2
    steps = math.ceil(half_x * scale) + 1
    near = Window.partitionBy(*track).orderBy(F.col("_xi")).rangeBetween(-steps, steps)
    out = df.withColumn("_xi", F.floor(F.col(x) * scale).cast("long")).withColumn("_around", F.collect_list(F.struct(F.col(x).alias("x"), F.col(h).alias("h"))).over(near))
    gaps = F.transform(F.filter("_around", lambda p: (F.abs(p["x"] - F.col(x)) <= half_x) & (F.abs(p["h"] - F.col(h)) <= half_h)), lambda p: F.abs(p["h"] - F.col(h)))
    # the row itself is among them, with a gap of 0
    out = out.withColumn("_gaps", F.array_sort(gaps)).drop("_around").withColumn("_n", F.size("_gaps") - 1)
    out = out.withColumn("_k", F.greatest(F.floor(F.sqrt("_n")).cast("int"), F.lit(least)))
    out = out.withColumn("_w", F.aggregate(F.slice("_gaps", F.lit(2), F.least("_k", "_n")), F.lit(0.0), lambda a, g: a + (half_h - g)))
    most = F.greatest(F.lit(least), F.max("_k").over(Window.partitionBy(*track, segment)))
    score = F.least(F.col("_w") / (half_h * most) * 255, F.lit(255.0))
    return out.withColumn("score", F.floor(score).cast("int")).drop("_xi", "_gaps", "_n", "_k", "_w")


# --- bathymetry


def refraction(theta: Column, depth: Column, n1: float = 1.00029, n2: float = 1.34116) -> tuple[Column, Column]:
    """Shift in height and along the line of sight of a photon under water; theta: angle of incidence in radians."""
    below = F.asin(F.lit(n1) * F.sin(theta) / n2)
    s = depth / F.cos(theta)
    r = s * (n1 / n2)
    turn = theta - below
    p = F.sqrt(r * r + s * s - 2 * r * s * F.cos(turn))
    alpha = F.asin(F.when(p == 0, 0.0).otherwise(F.try_divide(r * F.sin(turn), p)))
    beta = math.pi / 2 - theta - alpha
    return p * F.sin(beta), p * F.cos(beta)


def refracted(df: DataFrame, height: str, surface: str, elevation: str, azimuth: str, cls: str, surface_class: int, n1: float = 1.00029, n2: float = 1.34116) -> DataFrame:
    """df with dz, de, dn: shifts of rows below the water surface, 0 for all others."""
    # each step is a column of its own, so no expression is worked out more than once
    names = ("_depth", "_theta", "_turn", "_s", "_r", "_p", "_beta")
    col = F.col
    out = df.withColumn("_depth", col(surface) - col(height)).withColumn("_theta", math.pi / 2 - col(elevation))
    out = out.withColumn("_turn", col("_theta") - F.asin(F.lit(n1) * F.sin("_theta") / n2)).withColumn("_s", col("_depth") / F.cos("_theta"))
    out = out.withColumn("_r", col("_s") * (n1 / n2)).withColumn("_p", F.sqrt(col("_r") * col("_r") + col("_s") * col("_s") - 2 * col("_r") * col("_s") * F.cos("_turn")))
    alpha = F.asin(F.when(col("_p") == 0, 0.0).otherwise(F.try_divide(col("_r") * F.sin("_turn"), col("_p"))))
    out = out.withColumn("_beta", math.pi / 2 - col("_theta") - alpha)
    # NaN is greater than any number; without a surface nothing is shifted
    under = (col("_depth") > 0) & ~F.isnan("_depth") & (col(cls) != surface_class)
    dz, dy, zero = col("_p") * F.sin("_beta"), col("_p") * F.cos("_beta"), F.lit(0.0)
    return out.withColumns({"dz": F.when(under, dz).otherwise(zero), "de": F.when(under, dy * F.sin(azimuth)).otherwise(zero), "dn": F.when(under, dy * F.cos(azimuth)).otherwise(zero)}).drop(*names)


def row_flags(score: Column, boundary: Column, night: Column) -> Column:
    """Density score in the highest byte, boundary and night in the lowest bits."""
    return F.shiftleft(score.cast("int"), 24).bitwiseOR(boundary.cast("int")).bitwiseOR(F.shiftleft(night.cast("int"), 1))


def water_surface(h: np.ndarray, t: np.ndarray, rate: np.ndarray, binsize: float = 0.5, max_range: float = 1000.0, max_bins: int = 10000, threshold: float = 3.0, separation: float = 0.5, ratio: float = 1.2) -> float:
    """Height of the water surface in a chunk of rows, NaN if no peak stands out of the noise."""
    lo, hi = float(h.min()), float(h.max())
    if not 0 < hi - lo <= max_range:
        return math.nan
    bins = int((hi - lo) / binsize) + 1
    if bins > max_bins:
        return math.nan
    counts = np.bincount(np.minimum(((h - lo) / binsize).astype(int), bins - 1), minlength=bins).astype(float)
    shots = max(round((float(t.max()) - float(t.min())) / 1e-4), 1)
    noise = binsize * 2e-8 / 3 * shots * float(rate.mean())
    sigma = math.sqrt(max(noise, 0.0))
    reach = max(int(math.ceil(sigma)) * 3, 1)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(sigma, 1.0)) ** 2)
    smooth = np.convolve(counts, kernel / kernel.sum(), "full")[reach : reach + bins]
    first = int(np.argmax(smooth))
    far = np.abs(np.arange(bins) - first) * binsize > separation
    best = first
    if far.any():
        second = int(np.argmax(np.where(far, smooth, -1)))
        if smooth[second] * ratio >= smooth[first] and second > first:
            best = second
    if smooth[best] < noise + threshold * sigma:
        return math.nan
    return lo + best * binsize + binsize / 2


def sea_surface(df: DataFrame, track: list[str], order: list[str], h: str, t: str, rate: str, chunk: int = 8192, **options) -> DataFrame:
    """track, extent, surface_h of chunks of rows."""
    from terrane.operators.extents import fixed_count

    kinds = {f.name: f.dataType.simpleString() for f in df.select(*track).schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = {c: part[c].iloc[0] for c in [*track, "extent"]}
        return pd.DataFrame([row | {"surface_h": water_surface(part[h].to_numpy(float), part[t].to_numpy(float), part[rate].to_numpy(float), **options)}])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", extent long, surface_h double"
    return fixed_count(df, track, order, chunk).groupBy(*track, "extent").applyInPandas(run, schema)


def with_sea_surface(df: DataFrame, track: list[str], order: list[str], h: str, seconds: str, rate: str, chunk: int = 8192, **options) -> DataFrame:
    """df with `surface_h`, the height of the water surface in each row's chunk; a task holds one chunk at a time."""
    from terrane.operators.extents import fixed_count

    @pandas_udf("double")
    def surface(hs: pd.Series, ts: pd.Series, rates: pd.Series) -> float:
        return water_surface(hs.to_numpy(float), ts.to_numpy(float), rates.to_numpy(float), **options)

    # the chunks of a track are where the track is, so rows are shuffled once
    found = surface(h, seconds, rate).over(Window.partitionBy(*track, "extent"))
    return fixed_count(df, track, order, chunk).withColumn("surface_h", F.coalesce(found, F.lit(float("nan")))).drop("extent")


def signal_strength(x: np.ndarray, h: np.ndarray, width: float = 20.0, step: float = 10.0, binsize: float = 0.2, shift: float = 0.1) -> np.ndarray:
    """Score 0 to 255 of each row: how far its height bin stands above the background, the largest over overlapping windows and bin offsets."""
    score = np.zeros(len(x))
    if not len(x):
        return score
    for start in np.arange(x.min() - width + step, x.max() + step, step):
        rows = np.flatnonzero((x >= start) & (x < start + width))
        if not len(rows):
            continue
        for offset in (0.0, shift):
            b = np.floor((h[rows] - h[rows].min() + offset) / binsize).astype(int)
            counts = np.bincount(b)
            lowest = np.sort(counts)[: max(len(counts) // 2, 1)]
            above = counts - lowest.mean()
            top = above.max()
            if top > 0:
                score[rows] = np.maximum(score[rows], np.clip(above[b] / top * 255, 0, 255))
    return np.floor(score)


def with_signal_strength(df: DataFrame, track: list[str], x: str, h: str) -> DataFrame:
    """df with `strength` of each row of a track."""
    schema = df.withColumn("strength", F.lit(0)).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(strength=signal_strength(part[x].to_numpy(float), part[h].to_numpy(float)).astype("int32"))

    return df.groupBy(*track).applyInPandas(run, schema)
