"""Data products: the columns of each, where its files are, and how tracks are keyed.

Columns are names and Spark types. Types without a sign are widened; times are whole nanoseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geo

_TRACK = "spot int, cycle int, region int, rgt int, gt int, granule string"


@dataclass(frozen=True)
class Product:
    name: str
    columns: str
    keys: str = _TRACK
    x: str = "longitude"
    y: str = "latitude"
    time: str = "time_ns"
    order: str = "time_ns"
    optional: str = ""
    notes: dict = field(default_factory=dict)

    @property
    def schema(self) -> str:
        return ", ".join(s for s in (self.columns, self.keys) if s)


#: Columns of the supported products.
PRODUCTS = {
    p.name: p
    for p in (
        Product("photons", "time_ns long, latitude double, longitude double, segment_id int, x_atc double, y_atc float, height float, solar_elevation float, background_rate double, spacecraft_velocity float, atl03_cnf tinyint, quality_ph tinyint, ph_index long", optional="atl08_class tinyint, relief float, yapc_score tinyint, atl24_class tinyint, atl24_confidence float, geoid_corr_h float, dem_h float, ref_el float, ref_az float"),
        Product("land_ice", "time_ns long, latitude double, longitude double, segment_id int, h_li float, h_li_sigma float, atl06_quality_summary tinyint, x_atc double, y_atc float, dh_fit_dx float, n_fit_photons int, rms_misfit float, seg_azimuth float, sigma_geo_h float, w_surface_window_final float, bsnow_conf tinyint, bsnow_h float, r_eff float, tide_ocean float"),
        Product("vegetation", "time_ns long, latitude double, longitude double, segment_id_beg int, segment_landcover tinyint, segment_snowcover tinyint, n_seg_ph int, solar_elevation float, terrain_slope float, n_te_photons int, h_te_uncertainty float, h_te_median float, h_canopy float, h_canopy_uncertainty float, segment_cover short, n_ca_photons int, h_max_canopy float, h_min_canopy float, h_mean_canopy float, canopy_openness float, canopy_h_metrics array<float>"),
        Product("inland_water", "time_ns long, latitude double, longitude double, segment_id_beg int, ht_ortho float, ht_water_surf float, stdev_water_surf float, water_depth float, refid long"),
        Product("bathymetry", "class_ph tinyint, confidence double, time_ns long, lat_ph double, lon_ph double, ortho_h float, surface_h float, x_atc double, y_atc double", x="lon_ph", y="lat_ph", optional="index_ph int, ellipse_h float, invalid_kd tinyint, invalid_wind_speed tinyint, low_confidence_flag tinyint, night_flag tinyint, sensor_depth_exceeded tinyint, sigma_thu float, sigma_tvu float"),
        Product("waveforms_l1b", "shot_number long, time_ns long, latitude double, longitude double, elevation_start float, elevation_stop double, solar_elevation double, tx_size int, rx_size int, flags tinyint, tx_waveform array<float>, rx_waveform array<float>", keys="beam int, orbit int, track int, granule string"),
        Product("waveforms_l2a", "shot_number long, time_ns long, latitude double, longitude double, elevation_lm float, elevation_hr float, solar_elevation float, sensitivity float, flags tinyint", keys="beam int, orbit int, track int, granule string"),
        Product("waveforms_l4a", "shot_number long, time_ns long, latitude double, longitude double, agbd float, elevation float, solar_elevation float, sensitivity float, flags tinyint", keys="beam int, orbit int, track int, granule string"),
        Product("airborne_l1b", "time_ns long, latitude double, longitude double, refh float", keys="granule string"),
        Product("swaths", "scan_id long, time_ns long, latitude double, longitude double", keys="granule string"),
    )
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """No rows, with the product's columns: what a request without data in its region returns."""
    return spark.createDataFrame([], PRODUCTS[name].schema)


def read(spark: SparkSession, name: str, path: str, resources: list[str] | None = None, ring: geo.Ring | None = None, fields: list[str] | None = None) -> DataFrame:
    """A product staged as Parquet. Resources, region and fields reach the scan as conditions and read columns."""
    p = PRODUCTS[name]
    df = spark.read.parquet(path)
    if resources is not None:
        df = df.where(F.col("granule").isin(resources))
    if ring is not None:
        df = df.where(geo.in_polygon(F.col(p.x), F.col(p.y), ring))
    if fields is not None:
        known = [c.split()[0] for c in p.schema.split(", ")]
        df = df.select([c for c in df.columns if c in known or c in fields])
    return df


def granule_row(df: DataFrame, name: str) -> DataFrame:
    """Metadata of each resource: its track keys, number of rows and span of time."""
    p = PRODUCTS[name]
    keys = [c.split()[0] for c in p.keys.split(", ") if not c.startswith(("spot", "gt", "beam"))]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(p.time).alias("t0"), F.max(p.time).alias("t1"))
