"""Fixtures worked out by hand, and brute force for kernels."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geo, text, times
from terrane.operators import aggregates, algorithms, columns, extents, filters, joins, raster
from terrane.plans import api
from terrane.plans.request import CONFIDENCE, Request, members
from terrane.sources import products, readers, sinks
from terrane.streaming import dispatch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- frames and sets


def test_sources_are_numbered_and_must_agree(spark):
    a = spark.createDataFrame([(1, 2.0)], "a int, b double")
    merged, names = readers.numbered_sources({"x.h5": a, "y.h5": a})
    assert rows(merged) == [(1, 2.0, 0), (1, 2.0, 1)]
    assert rows(names) == [(0, "x.h5"), (1, "y.h5")]
    with pytest.raises(ValueError):
        readers.numbered_sources({"x": a, "y": a.withColumnRenamed("b", "c")})


def test_frame_chains_transforms(spark):
    frame = api.Frame(spark.range(5).toDF("a"), {"bob": 100, "bill": 200})
    out = frame.then(lambda d: d.where("a > 1"), lambda d: d.withColumn("b", F.col("a") * 2)).with_constants()
    assert rows(out.df) == [(2, 4, 100, 200), (3, 6, 100, 200), (4, 8, 100, 200)]


def test_index_of_a_whole_table_needs_no_single_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = columns.with_index(df, "pos", ["k"]).collect()
    assert all(r["k"] == r["pos"] for r in got)


# --- filters and geometry


def test_levels():
    assert members("atl03_high", CONFIDENCE, "atl03_") == [4]
    assert members(2, CONFIDENCE) == [2, 3, 4]
    assert members([4, 0], CONFIDENCE) == [0, 4]
    with pytest.raises(ValueError):
        members(9, CONFIDENCE)


def test_request_checks_names_and_values():
    r = Request.parse({"poly": [{"lon": 0, "lat": 0}, {"lon": 0, "lat": 1}, {"lon": 1, "lat": 1}], "cnf": 3, "track": 2, "atl03_ph_fields": ["a"], "timeout": 9})
    assert geo.signed_area(r.poly) > 0 and r.poly[0] == r.poly[-1]
    assert r.cnf == [3, 4] and r.beams == [30, 40] and r.anc_fields == ["a"]
    for bad in ({"no_such": 1}, {"len": 0}, {"resources": ["a"] * 5, "max_resources": 4}):
        with pytest.raises(ValueError):
            Request.parse(bad)


@pytest.mark.parametrize("lat", [*range(-80, -9, 10), *range(10, 81, 10)])
def test_projections_invert(spark, lat):
    kind = geo.NORTH if lat > 0 else geo.SOUTH
    df = spark.range(36).select((F.col("id") * 10 - 175).cast("double").alias("lon"), F.lit(float(lat)).alias("lat"))
    x, y = geo.project(F.col("lon"), F.col("lat"), kind)
    lon, back = geo.unproject(x, y, kind)
    worst = df.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(back - F.col("lat")))).first()
    assert max(worst) < 1e-7


def test_ring_of_many_edges_equals_the_inline_form(spark):
    rng = np.random.default_rng(3)
    ring = [(math.cos(t) * (1 + 0.3 * math.sin(5 * t)), math.sin(t)) for t in np.linspace(0, 2 * math.pi, 200, endpoint=False)]
    pts = spark.createDataFrame([tuple(map(float, p)) for p in rng.uniform(-1.5, 1.5, (300, 2))], "x double, y double")
    long = pts.select("x", "y", geo.in_ring(F.col("x"), F.col("y"), ring).alias("hit")).collect()

    def inside(x, y):
        hit = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                hit = not hit
        return hit

    assert all(r["hit"] == inside(r["x"], r["y"]) for r in long)
    assert 50 < sum(r["hit"] for r in long) < 250


def test_polygon_bounds_reach_the_scan(spark, tmp_path):
    spark.range(100).select((F.col("id") * 1.0).alias("lon"), F.lit(1.0).alias("lat")).write.parquet(str(tmp_path / "p"))
    df = filters.polygon(spark.read.parquet(str(tmp_path / "p")), "lon", "lat", [(10.0, 0.0), (20.5, 0.0), (20.5, 2.0), (10.0, 2.0)])
    assert "GreaterThanOrEqual(lon" in df._jdf.queryExecution().toString()
    assert [r["lon"] for r in df.orderBy("lon").collect()] == [float(k) for k in range(10, 21)]


def test_contiguous_extent_drops_re_entries_and_skips_empty_segments(spark):
    df = spark.createDataFrame([(k, v, c) for k, (v, c) in enumerate([(0, 5), (1, 5), (0, 0), (1, 5), (0, 5), (1, 5)])], "pos int, v int, n int").withColumn("t", F.lit(1))
    assert [r["pos"] for r in filters.contiguous_extent(df, ["t"], ["pos"], F.col("v") == 1).collect()] == [1]
    assert sorted(r["pos"] for r in filters.contiguous_extent(df, ["t"], ["pos"], F.col("v") == 1, F.col("n")).collect()) == [1, 2, 3]


def test_interval_and_box_joins_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    a = [(k, float(x), float(x + w)) for k, (x, w) in enumerate(rng.uniform(0, 20, (80, 2)))]
    l, r = spark.createDataFrame(a, "i int, a0 double, a1 double"), spark.createDataFrame(a[::-1], "j int, b0 double, b1 double")
    got = {(x["i"], x["j"]) for x in joins.interval_overlap(l, r, ("a0", "a1"), ("b0", "b1"), 3.0).collect()}
    assert got == {(i, j) for i, p, q in a for j, s, t in a if p <= t and s <= q}
    l2, r2 = (d.withColumn(f"{n}y0", F.col(f"{n}0") / 2).withColumn(f"{n}y1", F.col(f"{n}1") / 2 + 1) for d, n in ((l, "a"), (r, "b")))
    found = joins.box_overlap(l2, r2, ("a0", "ay0", "a1", "ay1"), ("b0", "by0", "b1", "by1"), 4.0).collect()
    assert len(found) == len({(x["i"], x["j"]) for x in found}) == sum(p <= t and s <= q and p / 2 <= t / 2 + 1 and s / 2 <= q / 2 + 1 for _, p, q in a for _, s, t in a)


def test_asof_takes_the_last_and_clamps(spark):
    left = spark.createDataFrame([(1, k, k) for k in range(6)], "g int, t int, id int")
    right = spark.createDataFrame([(1, 2, 20), (1, 4, 40), (2, 0, 99)], "g int, t int, v int")
    assert [r["v"] for r in joins.asof(left, right, ["g"], "t", ["v"]).orderBy("id").collect()] == [20, 20, 20, 20, 40, 40]
    assert [r["v"] for r in joins.asof(left, right, ["g"], "t", ["v"], clamp=False).orderBy("id").collect()] == [None, None, 20, 20, 40, 40]


# --- functions


def test_gps_time_steps_over_leap_seconds(spark):
    cases = [(0.0, 315964800), (46828799.0, 315964800 + 46828799), (46828801.0, 315964800 + 46828800), (1167264017.0, 1483228799), (1167264018.0, 1483228800), (1198800018.0, 1514764800)]
    df = spark.createDataFrame([(g,) for g, _ in cases], "g double")
    got = [r[0] for r in df.select(times.gps_to_unix_ns(F.col("g"))).collect()]
    assert got == [s * 1_000_000_000 for _, s in cases]
    ns = spark.createDataFrame([(1514764800 * 1_000_000_000,)], "n long")
    assert ns.select(times.unix_ns_to_gps_ms(F.col("n"))).first()[0] == 1198800018000
    assert ns.select(times.mission_seconds_to_unix_ns(F.lit(0.0))).first()[0] == 1514764800 * 1_000_000_000


def test_text_functions(spark):
    df = spark.createDataFrame([("0x1F", "a-b-c", b"\xff\xfe\xfd")], "h string, s string, b binary")
    got = df.select(text.to_long(F.col("h")), text.find(F.col("s"), "-"), text.find(F.col("s"), "-", True), text.base64_url(F.col("b")), text.unbase64_url(text.base64_url(F.col("b")))).first()
    assert tuple(got) == (31, 1, 3, "__79", bytearray(b"\xff\xfe\xfd"))
    name = spark.createDataFrame([("ATL03_20181019065445_03150111_007_01.h5",)], "n string")
    parts = name.select(text.granule_parts(F.col("n")).alias("p"), text.companion(F.col("n"), "ATL08").alias("c")).first()
    assert (parts["p"]["year"], parts["p"]["rgt"], parts["p"]["cycle"], parts["p"]["region"], parts["p"]["version"]) == (2018, 315, 1, 11, 7)
    assert parts["c"] == "ATL08_20181019065445_03150111_007_01.h5"
    assert name.where(text.like(F.col("n"), text.orbit_pattern(315, 1, None))).count() == 1
    with pytest.raises(Exception, match="out of range"):
        spark.range(9, 10).select(text.bit_set(F.col("id"), 3)).collect()


def test_utm(spark):
    z, e, n = spark.range(1).select(*geo.utm(F.lit(-75.0), F.lit(40.0))).first()
    assert z == 18 and e == pytest.approx(500000, abs=0.01) and n == pytest.approx(4427757.219, abs=0.01)


# --- algorithms


def test_sliding_windows_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    for length, step in ((40, 20), (20, 40), (30, 7)):
        x = np.sort(rng.uniform(0, 300, 60))
        got = {(r["x"], r["extent"]) for r in extents.sliding(spark.createDataFrame([(1, float(v)) for v in x], "t int, x double"), ["t"], "x", length, step).collect()}
        assert got == {(v, k) for k in range(400) for v in x.tolist() if x[0] + k * step <= v < x[0] + k * step + length}


def test_anchored_windows():
    x = np.array([0.0, 5, 19, 21, 40, 41, 90])
    assert extents.anchored_bounds(x, 40, 20) == [(0, 4), (3, 6), (5, 6), (6, 7)]
    assert extents.anchored_bounds(x, 40, 20, True)[0] == (0, 5)


def test_robust_fit_finds_the_line_among_noise():
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(-20, 20, 300))
    h = 100 + 0.1 * x + rng.normal(0, 0.1, 300)
    noisy = np.concatenate([h, rng.uniform(50, 150, 60)])
    at = np.concatenate([x, rng.uniform(-20, 20, 60)])
    fit = algorithms.robust_fit(at, noisy, background=0.6, rounds=10)
    assert fit["h_mean"] == pytest.approx(100, abs=0.2) and fit["slope"] == pytest.approx(0.1, abs=0.03)
    assert fit["pflags"] in (0, algorithms.MAX_ITERATIONS)
    exact = algorithms.robust_fit(x, 3 + 2 * x)
    assert exact["h_mean"] == pytest.approx(3) and exact["slope"] == pytest.approx(2) and exact["rms_misfit"] == pytest.approx(0, abs=1e-9)
    assert algorithms.robust_fit(np.array([0.0, 1]), np.array([1.0, 2]))["pflags"] & algorithms.TOO_FEW


def test_fit_weights_give_the_value_at_the_centre():
    x = np.array([-3.0, -1, 2, 5])
    a, b, w = algorithms._line(x, 7 - 2 * x)
    assert a == pytest.approx(7) and b == pytest.approx(-2) and w @ (4 + 9 * x) == pytest.approx(4)


def test_canopy():
    relief = np.array([0.0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0.2])
    cls = np.array([2] * 9 + [3, 1])
    got = algorithms.canopy(relief, cls, relief + 100)
    assert (got["vegetation_photon_count"], got["ground_photon_count"], got["h_max_canopy"], got["h_canopy"], got["h_te_median"]) == (10, 1, 9.0, 9.0, 100.2)
    assert got["canopy_h_metrics"][0] == 0.0 and got["canopy_openness"] == pytest.approx(np.std(np.arange(10)))
    assert algorithms.canopy(np.array([1.0]), np.array([2]), np.array([1.0]))["pflags"] == algorithms.BIN_UNDERFLOW
    assert math.isnan(algorithms.canopy(np.array([1.0]), np.array([1]), np.array([1.0]))["h_canopy"])


def test_water_surface_stands_out():
    rng = np.random.default_rng(4)
    h = np.concatenate([rng.normal(0, 0.1, 400), rng.uniform(-20, 20, 200)])
    t = np.sort(rng.uniform(0, 1, 600))
    assert algorithms.water_surface(h, t, np.zeros(600)) == pytest.approx(0, abs=0.5)
    assert math.isnan(algorithms.water_surface(np.ones(5), np.arange(5.0), np.zeros(5)))


def test_straight_down_is_scaled_by_the_indices(spark):
    dz, dy = spark.range(1).select(*algorithms.refraction(F.lit(0.0), F.lit(10.0))).first()
    assert dz == pytest.approx(10 * (1 - 1.00029 / 1.34116), rel=1e-6) and dy == pytest.approx(0, abs=1e-9)


def test_single_sample_and_dsl(spark):
    df = spark.createDataFrame([([3.0, float("nan"), 1.0, 2.0, 5.0],)], "v array<double>")
    got = df.select(*[aggregates.single_sample("v", k) for k in ("first", "last", "mean", "median")]).first()
    assert tuple(got) == (3.0, 5.0, 2.75, 3.0)
    assert aggregates.parse_field("median(h)") == ("median", "h") and aggregates.parse_field("h") == ("mean", "h") and aggregates.parse_field("x(h)") == ("mean", "h")


# --- rasters


def test_zonal_disc_has_as_many_pixels_as_the_circle():
    assert len(raster.disc(15)) == 709 and len(raster.disc(5)) == 81


def test_slope_of_a_plane(spark):
    px = spark.createDataFrame([(r, c, 2.0 * c) for r in range(5) for c in range(5)], "row int, col int, value double")
    s = raster.slope_aspect(spark.createDataFrame([(1, 2, 2)], "id int, row int, col int"), px, ["id"], 1.0).first()
    assert s["slope"] == pytest.approx(math.degrees(math.atan(2))) and s["count"] == 9 and s["aspect"] == pytest.approx(180)


@pytest.mark.parametrize("kind", sorted(raster.KERNELS))
def test_resampling_keeps_a_constant(spark, kind):
    px = spark.createDataFrame([(r, c, 4.0) for r in range(15) for c in range(15)], "row int, col int, value double")
    pts = spark.createDataFrame([(1, 7, 7, 7.3, 7.6), (2, 0, 0, 0.5, 0.5)], "id int, row int, col int, fr double, fc double")
    got = {r["id"]: (r["value"], r["resampled"]) for r in raster.resample(pts, px, ["id"], kind).collect()}
    assert got[1] == (pytest.approx(4.0), True) and got[2] == (4.0, False)


def test_nodata():
    assert raster.radius_in_pixels(30, 2, 2) == 15 and raster.radius_in_pixels(0.1, 2, 2) == 1


# --- streams


def test_limits_and_metrics_of_counters(spark):
    df = spark.range(1, 10011).select(F.explode(F.array(F.lit(50), F.lit(150))).alias("id"), F.col("id").alias("counter"))
    assert dispatch.limit(df, "id", 50, 150).count() == 0
    out = dispatch.limit(df, "counter", 11, 10000, "id", 50).agg(F.count("*"), F.sum("counter")).first()
    assert tuple(out) == (20, 100110)
    two = spark.range(1, 101).select(F.explode(F.array(F.lit(1000), F.lit(2000))).alias("id"), F.col("id").alias("counter"))
    m = dispatch.metric(two, "counter", ["id", "counter"], "test.rec")
    assert m.count() == 400
    assert rows(m.groupBy("name").agg(F.sum("value"))) == [("test.rec.counter", 10100.0), ("test.rec.id", 300000.0)]


def test_unpack(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b")])], "k int, recs array<struct<x:int,y:string>>")
    assert rows(dispatch.unpack(df, "recs")) == [(1, 1, "a"), (1, 2, "b")]


# --- files


def test_packets(spark):
    def packet(apid, seq, body):
        return struct.pack(">HHH", 0x0800 | apid, 0xC000 | seq, len(body) - 1) + body

    body = struct.pack(">IHI", 100, 0x8000, 7)
    data = packet(5, 0, body) + packet(6, 9, body) + packet(5, 1, body) + packet(5, 3, body) + b"\x08\x05"
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    got = readers.packet_fields(readers.packets(files), {"n": (6, 4)}).orderBy("offset").collect()
    assert [(r["apid"], r["sequence"], r["valid"], r["seconds"], r["n"]) for r in got] == [(5, 0, True, 100.5, 7), (6, 9, True, 100.5, 7), (5, 1, True, 100.5, 7), (5, 3, False, 100.5, 7)]
    assert readers.packets(files, [6]).count() == 1
    assert {r["apid"]: r["invalid"] for r in readers.packet_stats(readers.packets(files)).collect()} == {5: 1, 6: 0}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, -10.0, 5.0, 1.5), (2, 20.0, 6.0, 2.5)], "time_ns long, longitude double, latitude double, height double")
    sinks.write(df, sinks.Output(str(tmp_path / "g"), "geoparquet", meta={"a": 1}, with_schema=True))
    back = readers.points(spark, str(tmp_path / "g")).select(*df.columns)
    assert rows(back) == rows(df)
    keys = {r["key"]: json.loads(r["value"]) for r in spark.read.json(str(tmp_path / "g" / "_metadata_keys")).collect()}
    assert keys["a"] == 1 and keys["geo"]["primary_column"] == "geometry" and "geometry" not in keys["openapi"]["properties"]
    sinks.write(df, sinks.Output(str(tmp_path / "f"), "feather", fields=["height"]))
    import pyarrow as pa

    parts = [pa.ipc.open_file(str(p)).read_all() for p in (tmp_path / "f").glob("*.arrow")]
    assert sorted(v for t in parts for v in t.column("height").to_pylist()) == [1.5, 2.5] and parts[0].column_names == ["time_ns", "height"]
    sinks.write(df, sinks.Output(str(tmp_path / "x.las"), "las"))
    assert np.allclose(np.sort(sinks.read_las(str(tmp_path / "x.las")), 0), [[-10, 5, 1.5], [20, 6, 2.5]])
    with pytest.raises(ValueError):
        sinks.write(df, sinks.Output("x", "h5"))


def photons(spark, path):
    rng = np.random.default_rng(8)
    data = []
    for gt, spot in ((10, 1), (20, 2)):
        x = np.sort(rng.uniform(0, 200, 800))
        for k, v in enumerate(x.tolist()):
            data.append((k * 1_000_000, 10 + v / 1e5, 20.0, int(v // 20), float(v), 0.0, float(50 + 0.05 * v + rng.normal(0, 0.1)), 1.0, 0.0, 7000.0, int(rng.integers(0, 5)), 0, k, int(rng.integers(0, 5)), float(rng.uniform(0, 20)), spot, 1, 11, 315, gt, "g1"))
    schema = "time_ns long, latitude double, longitude double, segment_id int, x_atc double, y_atc double, height double, solar_elevation double, background_rate double, spacecraft_velocity double, atl03_cnf int, quality_ph int, ph_index long, atl08_class int, relief double, spot int, cycle int, region int, rgt int, gt int, granule string"
    spark.createDataFrame(data, schema).write.parquet(f"{path}/photons")


def test_run_answers_requests(spark, tmp_path):
    photons(spark, tmp_path)
    root = str(tmp_path)
    plain = api.run(spark, "atl03x", {"cnf": 4, "beams": ["gt1l"]}, root=root).df
    assert {(r["gt"], r["atl03_cnf"]) for r in plain.collect()} == {(10, 4)}
    fit = api.run(spark, "atl03x", {"fit": {}, "cnf": 0, "atl03_ph_fields": ["median(height)"]}, root=root)
    found = fit.df.collect()
    assert len(found) > 10 and all(abs(r["h_mean"] - (50 + 0.05 * r["x_atc"])) < 0.5 for r in found) and "median_height" in fit.df.columns
    assert api.run(spark, "atl06p", {"cnf": 0}, root=root).df.count() == len(found)
    aoi = [(19.0, 10.0005), (21.0, 10.0005), (21.0, 10.001), (19.0, 10.001)]
    inside = api.run(spark, "atl03x", {"cnf": 0}, aoi, root=root).df.agg(F.min("latitude"), F.max("latitude")).first()
    assert 10.0005 <= inside[0] and inside[1] <= 10.001
    assert api.run(spark, "atl08p", {"cnf": 0}, root=root).df.count() > 5
    assert api.run(spark, "atl03x", {"als": {}, "cnf": 0}, root=root).df.count() > 5
    assert api.run(spark, "atl03x", {"yapc": {"version": 3, "score": 10}, "cnf": 0}, root=root).df.count() > 5
    assert api.run(spark, "indexer", {}, root=root).df.count() == 1
    assert api.run(spark, "atl03x", {"resources": ["none"]}, root=root).df.count() == 0
    out = api.run(spark, "atl03x", {"cnf": 4, "output": {"path": f"{root}/out", "format": "geoparquet"}}, root=root)
    assert "geometry" in spark.read.parquet(f"{root}/out").columns and out.df.count() > 0
    with pytest.raises(ValueError):
        api.run(spark, "nothing", {}, root=root)


def test_bathymetry_requests(spark, tmp_path):
    photons(spark, tmp_path)
    staged = spark.read.parquet(f"{tmp_path}/photons")
    # 800 photons a track: odd ones at the water surface, even ones 0 to 9 m below it; the last 200 are noise
    k = F.col("ph_index")
    bottom = -(k % 9).cast("double") - 1
    h = F.when(k >= 600, (k * 37 % 200).cast("double") / 2 - 60).when(k % 2 == 1, 0.1).otherwise(bottom)
    wet = staged.withColumns({"geoid_corr_h": h, "dem_h": F.col("height") - F.when(k == 0, 60.0).otherwise(1.0), "ref_el": F.lit(1.4), "ref_az": F.lit(0.5), "background_rate": F.when(k >= 600, 1e8).otherwise(100.0), "time_ns": k * 100_000})
    wet.write.parquet(f"{tmp_path}/wet/photons")
    root = f"{tmp_path}/wet"
    rows = api.run(spark, "bathyx", {"ph_in_extent": 200, "min_geoid_delta": -70.0}, root=root).df.toPandas()
    assert len(rows) == 2 * 799 and not rows["ph_index"].eq(0).any()
    # chunks are counted after the filter, so each begins a row later
    low = rows[rows.ph_index > 600]
    assert low.surface_h.isna().all() and (low.processing_flags == 4).all() and (low.dz == 0).all() and (low.ortho_h == low.geoid_corr_h).all()
    top = rows[rows.ph_index <= 600]
    assert ((top.surface_h - 0.1).abs() <= 0.5).all() and (top.processing_flags == 0).all()
    depth = top.surface_h - top.geoid_corr_h
    below = top[depth > 0]
    theta = np.pi / 2 - 1.4
    shorter = 1.00029 / 1.34116
    turn = theta - np.arcsin(np.sin(theta) * shorter)
    s = depth[depth > 0] / np.cos(theta)
    p = s * np.sqrt(shorter**2 + 1 - 2 * shorter * np.cos(turn))
    beta = np.pi / 2 - theta - np.arcsin(s * shorter * np.sin(turn) / p)
    assert np.allclose(below.dz, p * np.sin(beta)) and np.allclose(below.de, p * np.cos(beta) * np.sin(0.5)) and (below.dz > 0).all()
    plain = api.run(spark, "bathyx", {"ph_in_extent": 200, "refraction": {"ri_water": 1.00029, "use_water_ri_mask": False}}, root=root).df
    assert plain.where("abs(dz) > 1e-6").count() == 0
    for bad in ({"surface": {"model_as_poisson": False}}, {"refraction": {"use_water_ri_mask": True}}, {"surface": {"other": 1}}, {"ph_in_extent": 0}):
        with pytest.raises(ValueError):
            api.run(spark, "bathyx", bad, root=root)
    with pytest.raises(ValueError):
        api.run(spark, "bathyx", {}, root=str(tmp_path))
    with pytest.raises(ValueError):
        api.run(spark, "bathyv", {}, root=root)
    half = [(19.0, 10.0), (21.0, 10.0), (21.0, 10.001), (19.0, 10.001)]
    counts = api.run(spark, "bathyv", {"region_mask": half, "cellsize": 0.0001}, root=root).df.collect()
    assert len(counts) == 2
    for c in counts:
        track = staged.where(F.col("gt") == c["gt"]).toPandas()
        segments = track.sort_values("ph_index").groupby("segment_id").agg(n=("gt", "size"), lat=("latitude", "first"))
        inside = segments[segments.lat < 10.001]
        assert (c["photons"], c["segments"], c["photons_inside"], c["segments_inside"], c["errors"]) == (800, len(segments), inside.n.sum(), len(inside), 0)


def test_every_request_type_has_a_product(spark):
    for name in api.ENDPOINTS:
        assert api.describe(name)["columns"]
    for name in products.PRODUCTS:
        assert products.empty(spark, name).count() == 0
    assert api.version()["request_types"]


# --- boxes, lookups, maths


def test_boxes():
    from terrane.operators import boxes

    assert boxes.split((0, 0, 4, 2)) == ((0, 0, 2, 2), (2, 0, 4, 2)) and boxes.split((0, 0, 2, 4))[1] == (0, 2, 2, 4)
    assert boxes.intersect((0, 0, 2, 2), (1, 1, 3, 3)) == (1, 1, 2, 2) and boxes.intersect((0, 0, 1, 1), (2, 2, 3, 3)) is None
    assert boxes.combine((0, 0, 1, 1), (2, 2, 3, 3)) == (0, 0, 3, 3)


def test_catalog_of_intervals_points_and_boxes(spark):
    from terrane.operators import boxes

    index = spark.createDataFrame([(i, float(i), float(i), [1, 2, 3][i % 3]) for i in range(1, 46)], "name int, t0 double, t1 double, foot int")
    want = spark.createDataFrame([(5.0, 17.0)], "q0 double, q1 double")
    assert sorted(r["name"] for r in joins.interval_overlap(index, want, ("t0", "t1"), ("q0", "q1"), 10.0).collect()) == list(range(5, 18))
    assert joins.point_index(index, "foot", 2).count() == 15
    cat = spark.createDataFrame([(1, -100.0, -80.0, -90.0, -70.0), (2, 46.0, -82.0, 50.0, -75.0), (3, 60.0, -70.0, 65.0, -60.0)], "id int, lon0 double, lat0 double, lon1 double, lat1 double")
    assert [r["id"] for r in boxes.query(cat, ("lon0", "lat0", "lon1", "lat1"), (45.0, -83.2, 55.0, -73.2), geo.SOUTH).collect()] == [2]
    assert boxes.hull(cat, "lon0", "lat0") == (-100.0, -82.0, 60.0, -70.0)
    at = lambda v, how: [r["name"] for r in boxes.lookup(index, "t0", v, how).collect()]
    assert (at(7.5, "at_or_after"), at(7.5, "before"), at(45.0, "after"), at(3.0, "exact")) == ([8], [7], [], [3])


def test_maths():
    from terrane.functions import maths

    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert maths.centroid(square) == (1.0, 1.0) and maths.winding(square) == 1 and maths.winding(square[::-1]) == -1
    assert maths.sphere_area([(0, 0), (1, 0), (1, 1), (0, 1)]) == pytest.approx(1.2364e10, rel=1e-3)
    a = np.array([0.0, 1, 0, 0, 0, 0])
    assert np.argmax(maths.correlation(np.roll(a, 2), a)) == 2 and maths.bit_reverse(0b0011, 4) == 0b1100
    assert geo.simplify([(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2)], 0.1) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_packets_are_wrapped_and_forwarded(spark):
    body = bytearray(b"\x01\x02\x03")
    df = readers.packetize(spark.createDataFrame([(16385, body), (2, bytearray(b"\x01\x02\x04"))], "n long, b binary"), "b", 9, "n")
    files = df.select(F.lit("f").alias("path"), F.col("packet").alias("content"))
    got = readers.packets(files)
    assert sorted((r["apid"], r["sequence"], bytes(r["payload"])) for r in got.collect()) == [(9, 1, bytes(body)), (9, 2, b"\x01\x02\x04")]
    assert readers.forward(got, [9], 3, check=True).count() == 1 and readers.forward(got, [8]).count() == 0


def test_batches_and_callbacks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, kind string, v double")
    assert rows(dispatch.unpack(dispatch.batched(df, ["k"]), "records")) == rows(df)
    df.write.parquet(str(tmp_path / "s"))
    seen = {}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    counted = dispatch.observed(stream, "counters", {"read": F.count("*")})
    dispatch.deliver(counted, {"a": lambda part, n: seen.setdefault("a", part.count()), "b": lambda part, n: seen.setdefault("b", part.count())}, "kind").awaitTermination()
    assert seen == {"a": 2, "b": 1}


def test_raster_helpers(spark):
    px = raster.from_grid(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert px.count() == 4
    region, corner = raster.from_region(spark, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 1.0)
    assert corner == (0.0, 2.0) and rows(region) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]
    pts = spark.createDataFrame([(1, 0, 0), (2, 9, 9)], "id int, row int, col int")
    assert rows(raster.flags_of(pts, px, []).select("id", "flags")) == [(1, 1), (2, 0)]


def test_client(spark, tmp_path):
    photons(spark, tmp_path)
    client = api.Client(spark, str(tmp_path))
    assert client.atl03sp({"cnf": 4}).df.count() > 0
    with pytest.raises(AttributeError):
        client.nothing
    spark.createDataFrame([(19.0, 11.0, 1.0, 1.0)], "x0 double, y0 double, dx double, dy double").write.parquet(str(tmp_path / "rasters/dem/geometry"))
    raster.from_grid(spark, [[1.0, 2.0], [3.0, 4.0]]).write.parquet(str(tmp_path / "rasters/dem/pixels"))
    pts = spark.createDataFrame([(1, 20.5, 9.5), (2, 50.0, 50.0)], "id int, longitude double, latitude double")
    assert rows(client.sample(pts, "dem").select("id", "`value.value`")) == [(1, 4.0), (2, None)]


def test_sampling_options(spark, tmp_path):
    where = str(tmp_path / "rasters/dem")
    spark.createDataFrame([(0.0, 3.0, 1.0, 1.0)], "x0 double, y0 double, dx double, dy double").write.parquet(f"{where}/geometry")
    raster.from_grid(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]).write.parquet(f"{where}/pixels")
    raster.from_grid(spark, [[0.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 0.0]]).write.parquet(f"{where}/flags")
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 50.0, 50.0), (3, 0.5, 2.5)], "id int, longitude double, latitude double")
    client = api.Client(spark, str(tmp_path))
    out = client.sample(pts, "dem", key="z", zonal_stats=True, radius=1.0, slope_aspect=True, with_flags=True)
    got = {r["id"]: r.asDict() for r in out.collect()}
    assert [got[i]["z.value"] for i in (1, 2, 3)] == [5.0, None, 1.0] and [got[i]["z.flags"] for i in (1, 2, 3)] == [5, 0, 0]
    middle = got[1]
    assert [middle[f"z.{c}"] for c in ("count", "min", "max", "mean", "median", "slope_count")] == [5, 2.0, 8.0, 5.0, 5.0, 9]
    assert middle["z.stdev"] == pytest.approx(2.0) and middle["z.mad"] == pytest.approx(1.6)
    # the plane rises by 1 a column and by 3 a row
    assert middle["z.slope"] == pytest.approx(math.degrees(math.atan(math.hypot(1, 3))))
    assert (got[3]["z.count"], got[2]["z.count"]) == (3, None)
    between = spark.createDataFrame([(1, 1.5, 1.5), (2, 1.25, 1.5)], "id int, longitude double, latitude double")
    assert rows(client.sample(between, "dem", key="z", algorithm="Bilinear").select("id", "`z.value`")) == [(1, 5.0), (2, 4.75)]
    for options in ({"algorithm": "Nothing"}, {"zonal_stats": True}, {"closest_time": "2020-01-01"}):
        with pytest.raises(ValueError):
            client.sample(pts, "dem", **options)


def test_filters_on_columns_that_are_missing_are_errors(spark, tmp_path):
    photons(spark, tmp_path)
    for parms in ({"podppd": 1}, {"atl24": {}} | {"atl24": {"class_ph": [40]}}):
        with pytest.raises(ValueError, match="needs the columns"):
            api.run(spark, "atl03x", parms, root=str(tmp_path))
    for parms in ({"proj": "EPSG:3857"}, {"datum": "EGM08"}, {"points_in_polygon": 3}):
        with pytest.raises(ValueError, match="not supported"):
            api.run(spark, "atl03x", parms, root=str(tmp_path))


@pytest.mark.parametrize("api_name, parms", [("bathyx", {"refraction": {"use_water_ri_mask": True}}), ("bathyx", {"surface": {"model_as_poisson": False}}), ("atl03x", {"srt": 1}), ("atl03x", {"yapc": {"version": 2}}), ("atl03x", {"samples": {"z": {"asset": "a", "closest_time": "2020-01-01"}}})])
def test_what_no_plan_carries_out_is_refused(spark, api_name, parms):
    with pytest.raises(ValueError, match="unknown request type|supported"):
        api.run(spark, api_name, parms)
