"""The one entry: run(api, parms, aoi, resources) on staged products gives a frame with its metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import __doc__ as _about
from terrane.functions import text
from terrane.operators import aggregates, algorithms, extents, filters, raster
from terrane.plans.request import CONFIDENCE, WATER_CLASSES, Request, defaults
from terrane.sources import products, readers, sinks
from terrane.sources.scratch import table

VERSION = "0.1.0"


@dataclass
class Frame:
    """A DataFrame with its metadata. `then` chains transforms, which run in order."""

    df: DataFrame
    meta: dict = field(default_factory=dict)
    crs: str = "EPSG:7912"

    def then(self, *steps) -> Frame:
        df = self.df
        for step in steps:
            df = df.transform(step)
        return Frame(df, self.meta, self.crs)

    def with_constants(self) -> Frame:
        return Frame(self.df.withColumns({k: F.lit(v) for k, v in self.meta.items() if isinstance(v, int | float | str)}), self.meta, self.crs)


#: Names of the request types and what each reads. Those with p or s at the end are the older forms of the same query.
ENDPOINTS = {
    "atl03x": "photons", "atl03s": "photons", "atl03sp": "photons", "atl03v": "photons", "atl03vp": "photons",
    "atl06": "photons", "atl06p": "photons", "atl08": "photons", "atl08p": "photons",
    "atl06x": "land_ice", "atl06s": "land_ice", "atl06sp": "land_ice",
    "atl08x": "vegetation", "atl13x": "inland_water", "atl13s": "inland_water", "atl13sp": "inland_water",
    "atl24x": "bathymetry", "bathyx": "photons", "bathyv": "photons",
    "gedi01b": "waveforms_l1b", "gedi01bp": "waveforms_l1b", "gedi01bx": "waveforms_l1b",
    "gedi02a": "waveforms_l2a", "gedi02ap": "waveforms_l2a", "gedi02ax": "waveforms_l2a",
    "gedi04a": "waveforms_l4a", "gedi04ap": "waveforms_l4a", "gedi04ax": "waveforms_l4a",
    "casals1bx": "airborne_l1b", "swotl2": "swaths", "swotl2p": "swaths", "indexer": "photons",
}


def _keys(p: products.Product) -> list[str]:
    return [c.split()[0] for c in p.keys.split(", ")]


def _subset(df: DataFrame, p: products.Product, r: Request) -> DataFrame:
    if r.resources is not None:
        df = df.where(F.col("granule").isin(r.resources))
    if r.t0 is not None or r.t1 is not None:
        ns = lambda t: (F.unix_micros(F.lit(t).cast("timestamp")) * 1000).cast("long")
        df = df.where(F.col(p.time) >= ns(r.t0)) if r.t0 is not None else df
        df = df.where(F.col(p.time) <= ns(r.t1)) if r.t1 is not None else df
    if r.region_mask is not None:
        on, lon0, lat0, lon1, lat1 = filters.rasterise(readers.region(r.region_mask), r.cellsize)
        return filters.region_mask(df, p.x, p.y, on, lon0, lat0, lon1, lat1, r.cellsize)
    if r.poly is not None:
        from terrane.functions import geo

        inside = geo.in_polygon(F.col(p.x), F.col(p.y), r.poly)
        if r.subsetting == "strict":
            return df.where(inside)
        return filters.contiguous_extent(df, _keys(p), [p.order], inside)
    return df


def _needed(df: DataFrame, option: str, *columns: str) -> None:
    """A filter that was asked for is never left out because its column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{option} needs the columns {missing}, which the staged product doesn't have")


def _photon_filters(df: DataFrame, r: Request) -> DataFrame:
    df = df.where(F.col("gt").isin(r.beams) & F.col("spot").isin(r.spots))
    df = df.where(F.col("atl03_cnf").isin(r.cnf) & F.col("quality_ph").isin(r.quality_ph))
    if r.podppd:
        _needed(df, "podppd", "podppd_flag")
        df = df.where(text.bit_set(F.col("podppd_flag"), r.podppd))
    if r.atl08_class is not None:
        _needed(df, "atl08_class", "atl08_class")
        df = df.where(F.col("atl08_class").isin(r.atl08_class))
    if r.yapc:
        if r.yapc.get("version", 0) == 3 or "yapc_score" not in df.columns:
            df = algorithms.density_score(df, ["granule", "gt"], "segment_id", "x_atc", "height", ["time_ns"], r.yapc.get("win_x", 15.0), r.yapc.get("win_h", 6.0), r.yapc.get("min_knn", 5)).withColumn("yapc_score", F.col("score")).drop("score")
        df = df.where(F.col("yapc_score") >= r.yapc.get("score", 0))
    if r.atl24:
        _needed(df, "atl24", "atl24_class", "atl24_confidence")
        df = df.where(F.col("atl24_class").isin(r.atl24.get("class_ph", [40])) & (F.col("atl24_confidence") >= r.atl24.get("confidence_threshold", 0.0)))
    return df


def _photon_algorithm(df: DataFrame, r: Request, api: str) -> DataFrame:
    track = ["granule", "gt"]
    if r.fit is not None or api in ("atl06", "atl06p"):
        options = {k: v for k, v in {"h_min": (r.fit or {}).get("H_min_win"), "sigma_max": (r.fit or {}).get("sigma_r_max"), "rounds": (r.fit or {}).get("maxi")}.items() if v is not None}
        out = algorithms.surface_fit(df, track, "x_atc", "height", r.len, r.res, rate="background_rate", pass_invalid=r.pass_invalid, least_rows=r.cnt, least_spread=r.ats, **options)
        if r.anc_fields:
            windows = extents.sliding(df, track, "x_atc", r.len, r.res)
            anc = windows.groupBy(*track, "extent").agg(*aggregates.ancillary(windows, r.anc_fields).values())
            out = out.join(anc, [*track, "extent"], "left")
        return out
    if r.als is not None:
        windows = extents.sliding(df, track, "x_atc", r.len, r.res)
        measures = algorithms.blanket(F.col("atl08_class"), F.col("height"), r.cnt, r.als.get("max_top_of_surface_percentile", 0.98), r.als.get("median_ground_percentile", 0.5))
        means = [aggregates.mean(F.col(c).cast("double")).alias(c) for c in ("time_ns", "latitude", "longitude", "x_atc", "y_atc")]
        return extents.summarise(windows, track, "x_atc", [*measures, *means, *aggregates.ancillary(windows, r.anc_fields).values()], r.cnt, r.ats, r.pass_invalid)
    if r.phoreal is not None or api in ("atl08", "atl08p"):
        o = r.phoreal or {}
        relief = "height" if o.get("use_abs_h") else "relief"
        return algorithms.canopy_metrics(df, track, "x_atc", relief, "atl08_class", "height", r.len, r.res, o.get("binsize", 1.0), o.get("geoloc", "median"))
    return df


#: Options of the water surface and of refraction: names in requests and of the kernels' parameters.
SURFACE = {"bin_size": "binsize", "max_range": "max_range", "max_bins": "max_bins", "signal_threshold": "threshold", "min_peak_separation": "separation", "highest_peak_ratio": "ratio"}
REFRACTION = {"ri_air": "n1", "ri_water": "n2"}
#: Known options with the only value that a plan carries out.
FIXED = {"model_as_poisson": True, "use_water_ri_mask": False}
SURFACE_UNDETECTED = 0x4
MOST_IN_SEGMENT = 100_000


def _named(option: str, given: dict | None, names: dict[str, str]) -> dict:
    """Parameters of a kernel from an option of a request."""
    for k, v in (given or {}).items():
        if k not in names and FIXED.get(k) != v:
            raise ValueError(f"{option}: {k} = {v!r} is not supported")
    return {names[k]: v for k, v in (given or {}).items() if k in names}


def _bathymetry(df: DataFrame, r: Request) -> DataFrame:
    """Photons near the ground model and the geoid, with the water surface and heights corrected for refraction.

    surface_h is the surface in chunks of ph_in_extent rows, NaN with a bit of processing_flags where none was found. Photons below
    it are shifted by dz, de (east) and dn (north) in metres; ortho_h has dz in it, geoid_corr_h has not. class_ph is the staged class, or 0.
    """
    surface, refraction = _named("surface", r.surface, SURFACE), _named("refraction", r.refraction, REFRACTION)
    _needed(df, "bathyx", "geoid_corr_h", "dem_h", "ref_el", "ref_az")
    df = df.where((F.col("height") - F.col("dem_h")).between(r.min_dem_delta, r.max_dem_delta) & F.col("geoid_corr_h").between(r.min_geoid_delta, r.max_geoid_delta))
    df = df.withColumn("class_ph", F.coalesce("atl24_class", F.lit(0)).cast("int") if "atl24_class" in df.columns else F.lit(0)).withColumn("_seconds", F.col("time_ns") / 1e9)
    df = algorithms.with_sea_surface(df, ["granule", "gt"], ["time_ns", "ph_index"], "geoid_corr_h", "_seconds", "background_rate", r.ph_in_extent, **surface).drop("_seconds")
    df = algorithms.refracted(df, "geoid_corr_h", "surface_h", "ref_el", "ref_az", "class_ph", WATER_CLASSES["sea_surface"], **refraction)
    return df.withColumns({"ortho_h": F.col("geoid_corr_h") + F.col("dz"), "processing_flags": F.when(F.isnan("surface_h"), SURFACE_UNDETECTED).otherwise(0)})


def _in_mask(df: DataFrame, r: Request) -> DataFrame:
    """Photons and segments of each track, all and inside the region mask; a segment is where its first photon is."""
    if r.region_mask is None:
        raise ValueError("bathyv needs a region_mask")
    first = F.min_by(F.struct("longitude", "latitude"), F.struct("time_ns", "ph_index"))
    segments = df.groupBy("granule", "gt", "segment_id").agg(F.count("*").alias("n"), first.alias("at")).select("granule", "gt", "n", "at.longitude", "at.latitude")
    on, *box = filters.rasterise(readers.region(r.region_mask), r.cellsize)
    return aggregates.masked_counts(filters.in_region_mask(segments, "longitude", "latitude", on, *box, r.cellsize, "inside"), ["granule", "gt"], "n", F.col("inside"), MOST_IN_SEGMENT)


def _product_filters(df: DataFrame, name: str, r: Request) -> DataFrame:
    if name == "vegetation":
        for column, least in (("te_quality_score", r.te_quality_filter), ("can_quality_score", r.can_quality_filter)):
            if least is not None:
                _needed(df, column.replace("_score", "_filter"), column)
                df = df.where(F.col(column) >= least)
    if name.startswith("waveforms"):
        mask = 0x01 * r.degrade_filter | 0x02 * r.l2_quality_filter | 0x04 * r.l4_quality_filter | 0x80 * r.surface_filter
        # a set bit marks a row the filter lets pass, but for the first, which marks degraded ones
        good = mask & ~0x01
        if mask & 0x01:
            df = df.where(filters.flags_clear(F.col("flags").cast("int"), 0x01))
        if good:
            df = df.where(F.col("flags").cast("int").bitwiseAND(good) == good)
    if name == "inland_water" and r.atl13 and r.atl13.get("refid") is not None:
        df = filters.index_range(df, ["granule", "gt"], ["time_ns"], F.col("refid") == r.atl13["refid"])
    if name == "bathymetry" and r.atl24:
        df = df.where(F.col("class_ph").isin(r.atl24.get("class_ph", [40])) & (F.col("confidence") >= r.atl24.get("confidence_threshold", 0.0)))
        for column in ("invalid_kd", "invalid_wind_speed", "low_confidence_flag", "night_flag", "sensor_depth_exceeded"):
            wanted = r.atl24.get(column.removesuffix("_flag"))
            if wanted is not None:
                _needed(df, "atl24", column)
                df = df.where(F.col(column).isin(wanted))
    return df


def _refuse_unsupported(r: Request) -> None:
    """Options that are known but that no plan carries out are errors."""
    if r.srt != -1:
        raise ValueError("srt is not supported: photons have one confidence, not one for each surface type")
    if r.yapc and r.yapc.get("version", 0) not in (0, 3):
        raise ValueError(f"yapc version {r.yapc['version']} is not supported")
    _named("surface", r.surface, SURFACE)
    _named("refraction", r.refraction, REFRACTION)
    for key, s in (r.samples or {}).items():
        _sampling(key, s)


#: Sampling options and the values that change nothing.
SAMPLING = {"asset": None, "algorithm": "NearestNeighbour", "radius": 0.0, "zonal_stats": False, "slope_aspect": False, "slope_scale_length": 0.0, "with_flags": False}
#: Names of sampling algorithms in requests and of the kernels that carry them out.
ALGORITHMS = {"NearestNeighbour": None, "Bilinear": "bilinear", "Cubic": "cubic", "CubicSpline": "cubicspline", "Lanczos": "lanczos", "Average": "average", "Mode": "mode", "Gauss": "gauss"}


def _sampling(key: str, s: dict) -> dict:
    """The options of a sampling request with their defaults; unknown ones are errors."""
    o = SAMPLING | s
    if other := {k for k in s if k not in SAMPLING}:
        raise ValueError(f"samples {key!r}: {sorted(other)} not supported")
    if o["algorithm"] not in ALGORITHMS:
        raise ValueError(f"samples {key!r}: algorithm {o['algorithm']!r} is not one of {sorted(ALGORITHMS)}")
    if o["zonal_stats"] and o["radius"] <= 0:
        raise ValueError(f"samples {key!r}: zonal_stats needs a radius")
    return o


def run(spark: SparkSession, api: str, parms: dict, aoi=None, resources: list[str] | None = None, root: str = ".") -> Frame:
    """Plans a request on products staged under root, one Parquet folder each; nothing runs before the frame is used, but for outputs."""
    if api not in ENDPOINTS:
        raise ValueError(f"unknown request type {api!r}")
    given = dict(parms) | ({"poly": aoi} if aoi is not None else {}) | ({"resources": resources} if resources is not None else {})
    if api == "bathyx":
        given.setdefault("cnf", sorted(CONFIDENCE.values()))  # the surface is found among all photons
    r, name = Request.parse(given), ENDPOINTS[api]
    _refuse_unsupported(r)
    p = products.PRODUCTS[name]
    df = spark.read.parquet(f"{root}/{name}")
    df = _subset(df, p, replace(r, region_mask=None) if api == "bathyv" else r)
    df = _product_filters(df, name, r)
    if name == "photons":
        if api == "indexer":
            return Frame(aggregates.resource_index(df, "granule", "time_ns", "time_ns", "longitude", "latitude"), {"api": api})
        if api == "bathyv":
            return Frame(_in_mask(df, r), {"api": api})
        df = _photon_filters(df, r)
        df = _bathymetry(df, r) if api == "bathyx" else _photon_algorithm(df, r, api)
    for key, s in (r.samples or {}).items():
        df = sample(spark, df, f"{root}/rasters/{s['asset']}", key, s, p)
    frame = Frame(df, {"api": api, "request": given})
    if r.output is not None:
        o = {k: v for k, v in r.output.items() if k in ("path", "format", "fields", "crs")}
        frame.df = sinks.write(df, sinks.Output(x=p.x, y=p.y, **o))
    return frame


def sample(spark: SparkSession, df: DataFrame, path: str, key: str, s: dict, p: products.Product) -> DataFrame:
    """df with samples of a staged raster at each row, in columns that begin with key.

    A raster is a folder of pixels (row, col, value), a row of geometry (x0, y0, dx, dy) and, for with_flags, pixels of flags. value is the nearest pixel or
    what the algorithm makes of those around; zonal_stats adds count, min, max, mean, median, stdev and mad of the disc of the
    radius, slope_aspect adds slope, aspect and the number of pixels, with_flags adds flags. Rows outside have nulls. radius and pixels have one unit.
    """
    o = _sampling(key, s)
    g = spark.read.parquet(f"{path}/geometry").first()
    pixels = spark.read.parquet(f"{path}/pixels").select("row", "col", "value")
    row_id, x, y = f"_{key}_id", F.col(p.x), F.col(p.y)
    at = raster.pixel_of(df.withColumn(row_id, F.monotonically_increasing_id()), p.x, p.y, g["x0"], g["y0"], g["dx"], g["dy"])
    kind = ALGORITHMS[o["algorithm"]]
    if kind or o["zonal_stats"] or o["slope_aspect"]:
        at = table(at)  # row numbers that several joins agree on
    places = at.select(F.col(row_id).alias("id"), "row", "col", ((g["y0"] - y) / g["dy"]).alias("fr"), ((x - g["x0"]) / g["dx"]).alias("fc"))
    cells = lambda length: raster.radius_in_pixels(length, g["dx"], g["dy"]) if length > 0 else 0
    found = []
    if kind:
        found.append(raster.resample(places, pixels, ["id"], kind, cells(o["radius"])).drop("resampled"))
    if o["zonal_stats"]:
        found.append(raster.zonal(places, pixels, ["id"], cells(o["radius"])))
    if o["slope_aspect"]:
        found.append(raster.slope_aspect(places, pixels, ["id"], float(max(g["dx"], g["dy"])), o["slope_scale_length"]).withColumnRenamed("count", "slope_count"))
    out = at if kind else at.join(pixels.withColumnRenamed("value", f"{key}.value"), ["row", "col"], "left")
    if o["with_flags"]:
        flags = spark.read.parquet(f"{path}/flags").select("row", "col", F.col("value").cast("int").alias(f"{key}.flags"))
        out = out.join(flags, ["row", "col"], "left").withColumn(f"{key}.flags", F.coalesce(F.col(f"`{key}.flags`"), F.lit(0)))
    for part in found:
        names = [c for c in part.columns if c != "id"]
        out = out.join(part.select(F.col("id").alias(row_id), *[F.col(c).alias(f"{key}.{c}") for c in names]), row_id, "left")
    return out.drop("row", "col", row_id)


def describe(api: str) -> dict:
    """Columns of a request type's product."""
    p = products.PRODUCTS[ENDPOINTS[api]]
    return {"api": api, "product": p.name, "columns": [dict(zip(("name", "type"), c.split(), strict=True)) for c in p.schema.split(", ")]}


def version() -> dict:
    return {"version": VERSION, "about": _about, "defaults": defaults(), "request_types": sorted(ENDPOINTS)}


class Client:
    """Request types as methods: Client(spark, root).atl06p(parms, aoi, resources)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, api: str):
        if api not in ENDPOINTS:
            raise AttributeError(api)
        return lambda parms=None, aoi=None, resources=None: run(self.spark, api, parms or {}, aoi, resources, self.root)

    def sample(self, points: DataFrame, asset: str, x: str = "longitude", y: str = "latitude", key: str = "value", **options) -> DataFrame:
        """points with samples of a staged raster; options as in a request's samples."""
        return sample(self.spark, points, f"{self.root}/rasters/{asset}", key, options, products.Product("points", "", x=x, y=y))
