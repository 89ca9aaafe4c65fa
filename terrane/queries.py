"""The engine's queries on the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geo, text, times
from terrane.operators import aggregates, algorithms, columns, extents, filters, joins, raster
from terrane.plans import catalog
from terrane.sources import readers, sinks
from terrane.streaming import dispatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- events as tracks: user_id is the track, x the seconds since its first event, cls the class of an event

CLASSES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
LENGTH, STEP = 400_000.0, 200_000.0
TRACK = ["user_id"]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", times.micros(F.col("ts")))
    cls = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])[F.col("event_type")]
    first = F.min("us").over(Window.partitionBy("user_id"))
    return e.withColumn("x", (F.col("us") - first) / F.lit(1e6)).withColumn("cls", cls)


_TRACK_SQL = """
track AS (
  SELECT *, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS x,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls
  FROM events)"""
_WINDOWS_SQL = (
    _TRACK_SQL
    + f""",
windows AS (
  SELECT *, unnest(range(greatest(0, floor((x - {LENGTH}) / {STEP})::BIGINT + 1), floor(x / {STEP})::BIGINT + 1)) AS extent
  FROM track)"""
)


# --- filters


@query(f"WITH {_TRACK_SQL} SELECT event_id, user_id, cls FROM track WHERE cls IN (2, 3, 4) AND value >= 100")
def flt_confidence_set(spark, sf_dir):
    e = tracks(spark, sf_dir)
    return e.where(filters.confidence([F.col("cls")], filters.levels(2, range(5))) & (F.col("value") >= 100)).select("event_id", "user_id", "cls")


@query("""
SELECT l_orderkey, l_linenumber, (l_quantity::INTEGER & 4) = 0 AS clear FROM lineitem
WHERE l_linenumber IN (2, 4, 6) AND l_returnflag IN ('A', 'R')""")
def flt_bitmask(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = li.where(text.bit_set(F.col("l_linenumber"), 0b1010100) & filters.member(F.col("l_returnflag"), ["A", "R"], ["A", "N", "R"]))
    return kept.select("l_orderkey", "l_linenumber", filters.flags_clear(F.col("l_quantity").cast("int"), 4).alias("clear"))


RING = [(-5.0, 3.0), (40.0, -1.0), (80.0, 20.0), (50.0, 25.0), (45.0, 47.0), (10.0, 30.0), (-5.0, 3.0)]


def _ring_sql(x: str, y: str, ring) -> str:
    edges = [f"((radians({a[1]}::DOUBLE) > {y}) <> (radians({b[1]}::DOUBLE) > {y}) AND {x} < (radians({b[0]}::DOUBLE) - radians({a[0]}::DOUBLE)) * ({y} - radians({a[1]}::DOUBLE)) / (radians({b[1]}::DOUBLE) - radians({a[1]}::DOUBLE)) + radians({a[0]}::DOUBLE))::INTEGER" for a, b in zip(ring, [*ring[-1:], *ring[:-1]], strict=True) if a[1] != b[1]]
    return f"({' + '.join(edges)}) % 2 = 1"


@query(f"WITH c AS (SELECT c_custkey, c_acctbal / 100 AS lon, c_nationkey * 2.0::DOUBLE AS lat FROM customer) SELECT c_custkey, lon, lat FROM c WHERE {_ring_sql('radians(lon)', 'radians(lat)', RING)}")
def flt_polygon_raycast(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_nationkey") * 2.0).alias("lat"))
    return filters.polygon(c, "lon", "lat", RING)


@query("""
WITH s AS (SELECT s_suppkey, (s_suppkey * 37 % 360 - 180)::DOUBLE AS lon, 72 + s_nationkey * 0.5::DOUBLE AS lat FROM supplier)
SELECT s_suppkey, round(2 * tan(pi() / 4 - radians(lat) / 2) * cos(radians(lon)), 9) AS xn, round(2 * tan(pi() / 4 - radians(lat) / 2) * sin(radians(lon)), 9) AS yn,
       round(lon, 6) AS lon, round(lat, 6) AS lat
FROM s""")
def flt_polar_projection(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 360 - 180).cast("double").alias("lon"), (72 + F.col("s_nationkey") * 0.5).alias("lat"))
    x, y = geo.project(F.col("lon"), F.col("lat"), geo.NORTH)
    back = geo.unproject(x, y, geo.NORTH)
    return s.select("s_suppkey", r(x, 9).alias("xn"), r(y, 9).alias("yn"), r(F.when(F.abs(back[0] + 180) < 1e-9, -180.0).when(F.abs(back[0] - 180) < 1e-9, -180.0).otherwise(back[0])).alias("lon"), r(back[1]).alias("lat"))


MASK = "f0f0aa55"


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 100 AS lon, c_nationkey * 1.0::DOUBLE AS lat FROM customer),
k AS (SELECT *, floor((24 - lat) / 6)::INTEGER AS mr, floor((lon - 0) / 6)::INTEGER AS mc FROM c WHERE lon BETWEEN 0 AND 47.9 AND lat BETWEEN 0.1 AND 24)
SELECT c_custkey, lon, lat FROM k
WHERE (mr = 0 AND mc < 4) OR (mr = 1 AND mc < 4) OR (mr = 2 AND mc % 2 = 0) OR (mr = 3 AND mc % 2 = 1)""")
def flt_region_mask(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_nationkey") * 1.0).alias("lat"))
    return filters.region_mask(c, "lon", "lat", filters.decode_mask(MASK, 4, 8), 0.0, 0.1, 47.9, 24.0, 6.0)


@query(f"""
WITH {_TRACK_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, value BETWEEN 50 AND 450 AS inside FROM track),
f AS (SELECT *, min(CASE WHEN inside THEN pos END) OVER (PARTITION BY user_id) AS first_pos FROM p),
s AS (SELECT *, min(CASE WHEN NOT inside AND pos > first_pos THEN pos END) OVER (PARTITION BY user_id) AS stop_pos FROM f)
SELECT event_id, user_id, value FROM s WHERE pos >= first_pos AND (stop_pos IS NULL OR pos < stop_pos)""")
def flt_contiguous_extent(spark, sf_dir):
    return filters.contiguous_extent(tracks(spark, sf_dir), TRACK, ["us", "event_id"], F.col("value").between(50, 450)).select("event_id", "user_id", "value")


@query(f"""
WITH {_TRACK_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM track),
h AS (SELECT *, min(CASE WHEN cls = 4 AND value > 300 THEN pos END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN cls = 4 AND value > 300 THEN pos END) OVER (PARTITION BY user_id) AS hi FROM p)
SELECT event_id, user_id, cls FROM h WHERE pos BETWEEN lo AND hi""")
def flt_index_range(spark, sf_dir):
    return filters.index_range(tracks(spark, sf_dir), TRACK, ["us", "event_id"], (F.col("cls") == 4) & (F.col("value") > 300)).select("event_id", "user_id", "cls")


_HAVERSINE = f"2 * {geo.EARTH_RADIUS} * asin(sqrt(pow(sin((radians({{b}}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({{b}})) * pow(sin((radians({{a}}) - radians(lon)) / 2), 2)))"


@query(f"""
WITH s AS (SELECT s_suppkey, s_nationkey * 10.0::DOUBLE - 120 AS lon, s_acctbal / 200 AS lat FROM supplier)
SELECT s_suppkey, lon, lat FROM s WHERE {_HAVERSINE.format(a="-20.0::DOUBLE", b="20.0::DOUBLE")} <= 5000 * 1000.0""")
def flt_haversine_radius(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 10.0 - 120).alias("lon"), (F.col("s_acctbal") / 200).alias("lat"))
    return filters.radius(s, "lon", "lat", -20.0, 20.0, 5000.0)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gear%' AND p_brand LIKE 'Brand#_%' AND NOT contains(p_type, '_')")
def flt_name_like_escape(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(text.name_like(F.col("p_name"), "gear") & text.like(F.col("p_brand"), "Brand#_%") & ~text.name_like(F.col("p_type"), "_")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE dayofyear(o_orderdate) BETWEEN 60 AND 120 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30 12:00:00'")
def flt_time_and_day_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(times.in_day_range(F.col("o_orderdate"), "60:120") & catalog.time_filter("o_orderdate", "1995-01-01", "1997-06-30 12:00:00")).select("o_orderkey", "o_orderdate")


@query("SELECT n_nationkey, n_name FROM nation")
def flt_limit_guard(spark, sf_dir):
    return filters.limited(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 300)


# --- projections


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_quantity, 6) AS x_atc, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 9) AS velocity,
       l_quantity >= 50 AS filled, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS count_or_0, 7 AS rgt, 'a' AS granule
FROM lineitem""")
def prj_computed_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("h", F.when(F.col("l_quantity") >= 50, columns.FLOAT_FILL).otherwise(F.col("l_quantity"))).withColumn("k", F.when(F.col("l_linenumber") == 7, columns.INT_FILL).otherwise(F.col("l_linenumber")))
    li = columns.with_constants(columns.fill_normalised(li), {"rgt": 7, "granule": "a"})
    return li.select("l_orderkey", "l_linenumber", r(columns.along_track(F.col("l_extendedprice"), F.col("l_quantity"))).alias("x_atc"), r(columns.norm(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 9).alias("velocity"), F.isnan("h").alias("filled"), F.col("k").alias("count_or_0"), "rgt", "granule")


@query("""
SELECT o_orderkey, ((o_custkey % 1387) << 52) | ((o_orderkey % 30) << 36) | ((o_custkey % 15) << 32) | ((o_orderkey % 3 + 1) << 30) | ((o_orderkey & 268435455) << 2) | (o_custkey % 2) AS extent_id,
       (CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 * 2 + o_custkey % 2 + 1 WHEN o_orderkey % 5 = 1 THEN 6 - (o_orderkey % 3 * 2 + o_custkey % 2) ELSE 0 END)::INTEGER AS spot,
       (CASE WHEN o_orderkey % 5 <= 1 THEN (o_orderkey % 3 * 2 + o_custkey % 2 + 1) * 10 ELSE 0 END)::INTEGER AS gt
FROM orders""")
def prj_extent_id(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", text.pack_extent_id(c % 1387, k % 30, c % 15, k % 3 + 1, c % 2, k).alias("extent_id"), text.spot_number(k % 5, k % 3 + 1, c % 2).alias("spot"), text.ground_track(k % 5, k % 3 + 1, c % 2).alias("gt"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS pos_in_status FROM orders")
def prj_index(spark, sf_dir):
    o = columns.with_index(table(spark, sf_dir, "orders"), "pos_in_status", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return columns.with_index(o, "pos", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos", "pos_in_status")


@query("""
WITH p AS (SELECT vec_id, unnest(range(72)) AS k, embedding FROM embeddings)
SELECT vec_id, k, round(coalesce(CASE WHEN k < 10 + vec_id % 50 THEN embedding[k + 1] END, 0)::DOUBLE, 6) AS sample FROM p""")
def prj_waveform_pad(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("w", F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (10 + F.col("vec_id") % 50).cast("int")))
    return e.select("vec_id", F.posexplode(columns.fixed_list(F.col("w"), 72)).alias("k", "sample")).select("vec_id", F.col("k").cast("long").alias("k"), r("sample").alias("sample"))


# --- joins


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 3)::INTEGER AS cls, l_tax AS relief FROM lineitem WHERE l_returnflag <> 'N')
SELECT l.l_orderkey, l.l_linenumber, coalesce(min(c.cls), 4)::INTEGER AS cls, round(coalesce(min(c.relief), 0.0), 6) AS relief, count(*) AS n
FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, min(cls) AS cls, min(relief) AS relief FROM c GROUP BY ALL) c USING (l_orderkey, l_linenumber)
GROUP BY ALL""")
def join_merge_left(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    classed = li.where("l_returnflag <> 'N'").groupBy(*keys).agg(F.min((F.col("l_linenumber") % 3).cast("int")).alias("cls"), F.min("l_tax").alias("relief"))
    out = joins.merge_left(li.select(*keys), classed, keys, {"cls": 4, "relief": 0.0})
    return out.groupBy(*keys).agg(F.min("cls").alias("cls"), r(F.min("relief")).alias("relief"), F.count("*").alias("n"))


@query(f"""
WITH {_TRACK_SQL},
e AS (SELECT user_id, us, max(value) AS value FROM track WHERE cls = 4 GROUP BY ALL),
f AS (SELECT user_id, arg_min(value, us) AS value FROM e GROUP BY user_id)
SELECT t.event_id, t.user_id, coalesce(e.value, f.value) AS last_error
FROM track t ASOF LEFT JOIN e ON t.user_id = e.user_id AND t.us >= e.us LEFT JOIN f ON t.user_id = f.user_id WHERE t.cls <> 4""")
def join_asof_clamped(spark, sf_dir):
    t = tracks(spark, sf_dir)
    errors = t.where("cls = 4").select("user_id", "us", F.col("value").alias("last_error"))
    return joins.asof(t.where("cls <> 4").select("user_id", "us", "event_id"), errors, TRACK, "us", ["last_error"]).select("event_id", "user_id", "last_error")


@query(f"""
WITH {_TRACK_SQL},
b AS (SELECT user_id, us, max(value) AS value FROM track WHERE cls = 1 GROUP BY ALL),
p AS (SELECT t.event_id, t.user_id, t.us, b.us AS k0, b.value AS v0 FROM track t ASOF LEFT JOIN b ON t.user_id = b.user_id AND t.us >= b.us WHERE t.cls = 2),
n AS (SELECT p.*, b.us AS k1, b.value AS v1 FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.us <= b.us)
SELECT event_id, user_id, round(CASE WHEN k0 IS NULL THEN v1 WHEN k1 IS NULL THEN v0 WHEN k0 = k1 THEN v0 ELSE v0 + (v1 - v0) * ((us - k0)::DOUBLE / (k1 - k0)) END, 6) AS rate FROM n""")
def join_interpolate(spark, sf_dir):
    t = tracks(spark, sf_dir)
    rates = t.where("cls = 1").groupBy("user_id", "us").agg(F.max("value").alias("rate"))
    return joins.interpolate(t.where("cls = 2").select("user_id", "us", "event_id"), rates, TRACK, "us", "rate").select("event_id", "user_id", r("rate").alias("rate"))


@query("""
WITH a AS (SELECT o_orderkey AS a, epoch_us(o_orderdate) / 86400000000 AS a0, epoch_us(o_orderdate) / 86400000000 + 2 + o_orderkey % 5 AS a1 FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey AS b, epoch_us(o_orderdate) / 86400000000 AS b0, epoch_us(o_orderdate) / 86400000000 + o_orderkey % 3 AS b1 FROM orders WHERE o_orderstatus = 'P')
SELECT a, count(*) AS n, sum(b)::BIGINT AS total FROM a JOIN b ON a0 <= b1 AND b0 <= a1 GROUP BY a""")
def join_interval_overlap(spark, sf_dir):
    day = times.micros(F.col("o_orderdate")) / F.lit(86400000000.0)
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a"), day.alias("a0"), (day + 2 + F.col("o_orderkey") % 5).alias("a1"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("b"), day.alias("b0"), (day + F.col("o_orderkey") % 3).alias("b1"))
    return joins.interval_overlap(a, b, ("a0", "a1"), ("b0", "b1"), 5.0).groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("total"))


@query("""
WITH a AS (SELECT s_suppkey, s_acctbal / 100 AS ax0, s_nationkey * 1.0::DOUBLE AS ay0, s_acctbal / 100 + 0.5 AS ax1, s_nationkey + 1.5::DOUBLE AS ay1 FROM supplier),
b AS (SELECT c_custkey, c_acctbal / 100 AS bx0, c_nationkey * 1.0::DOUBLE AS by0, c_acctbal / 100 + 0.25 AS bx1, c_nationkey + 0.25::DOUBLE AS by1 FROM customer)
SELECT s_suppkey, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM a JOIN b ON ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 GROUP BY s_suppkey""")
def join_box_overlap(spark, sf_dir):
    box = lambda bal, nat, p, w, h: [(F.col(bal) / 100).alias(f"{p}x0"), (F.col(nat) * 1.0).alias(f"{p}y0"), (F.col(bal) / 100 + w).alias(f"{p}x1"), (F.col(nat) + F.lit(h)).alias(f"{p}y1")]
    a = table(spark, sf_dir, "supplier").select("s_suppkey", *box("s_acctbal", "s_nationkey", "a", 0.5, 1.5))
    b = table(spark, sf_dir, "customer").select("c_custkey", *box("c_acctbal", "c_nationkey", "b", 0.25, 0.25))
    hits = joins.box_overlap(a, b, ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), 2.0)
    return hits.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("""
WITH lakes AS (SELECT c_nationkey AS refid, list(DISTINCT dayofyear(o_orderdate)) AS granules FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
ids AS (SELECT dayofyear(o_orderdate) AS ids, 'G' || dayofyear(o_orderdate) AS granule, max(o_orderdate) AS begin_time FROM orders GROUP BY ALL),
f AS (SELECT DISTINCT granule FROM (SELECT unnest(granules) AS ids FROM lakes WHERE refid = 3) JOIN ids USING (ids) WHERE begin_time >= TIMESTAMP '1998-03-01'),
g AS (SELECT DISTINCT granule FROM (SELECT unnest(granules) AS ids FROM lakes WHERE refid = 5) JOIN ids USING (ids))
SELECT granule FROM f INTERSECT SELECT granule FROM g""")
def join_unnest_catalog(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").withColumn("ids", F.dayofyear("o_orderdate")), table(spark, sf_dir, "customer")
    lakes = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("refid")).agg(F.collect_set("ids").alias("granules"))
    ids = o.groupBy("ids").agg(F.max("o_orderdate").alias("begin_time")).withColumn("granule", F.concat(F.lit("G"), F.col("ids")))
    return catalog.both(catalog.lake_granules(lakes, ids, refid=3, t0="1998-03-01"), catalog.lake_granules(lakes, ids, refid=5))


@query("""
WITH s AS (SELECT o_orderkey, (o_custkey % 4)::INTEGER AS cnt FROM orders)
SELECT o_orderkey, unnest(range(1, cnt + 1))::INTEGER AS photon_index FROM s""")
def join_segment_rows(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("cnt"))
    return joins.segments_to_rows(s, "cnt").select("o_orderkey", "photon_index")


# --- aggregates


@query("""
SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_quantity < 50 THEN l_extendedprice END) / count(CASE WHEN l_quantity < 50 THEN 1 END), 4) AS mean,
       round(sum(CASE WHEN l_quantity < 50 THEN l_extendedprice END) / count(*), 4) AS mean_over_all
FROM lineitem GROUP BY ALL""")
def agg_reference_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("h", F.when(F.col("l_quantity") >= 50, columns.FLOAT_FILL).otherwise(F.col("l_extendedprice")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(r(aggregates.mean(F.col("h")), 4).alias("mean"), r(aggregates.mean(F.col("h"), True), 4).alias("mean_over_all"))


@query("""
WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, l_quantity AS mode FROM m QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) = 1)
SELECT l_returnflag, round(median(l_extendedprice), 4) AS median, any_value(mode)::DOUBLE AS mode, round(sum(l_tax), 4) AS total FROM lineitem JOIN b USING (l_returnflag) GROUP BY l_returnflag""")
def agg_median_mode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(r(aggregates.median(F.col("l_extendedprice")), 4).alias("median"), aggregates.mode(F.col("l_quantity")).alias("mode"), r(aggregates.total(F.col("l_tax")), 4).alias("total"))


@query("SELECT trunc(value * 0.1)::BIGINT AS value, count(*) AS count FROM events GROUP BY ALL")
def agg_unique_histogram(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "events"), "value", 0.1)


@query(f"""
WITH {_WINDOWS_SQL},
m AS (SELECT user_id, extent, arg_min(cls, (-n, cls))::DOUBLE AS mode_cls FROM (SELECT user_id, extent, cls, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL)
SELECT user_id, extent, round(avg(value), 6) AS value, round(median(value), 6) AS median_value, any_value(mode_cls) AS mode_cls, round(sum(x), 3) AS sum_x
FROM windows JOIN m USING (user_id, extent) GROUP BY ALL""")
def agg_ancillary_dsl(spark, sf_dir):
    w = extents.sliding(tracks(spark, sf_dir), TRACK, "x", LENGTH, STEP)
    out = w.groupBy("user_id", "extent").agg(*aggregates.ancillary(w, ["value", "median(value)", "mode(cls)", "sum(x)"]).values())
    return out.select("user_id", "extent", r("value").alias("value"), r("median_value").alias("median_value"), "mode_cls", r("sum_x", 3).alias("sum_x"))


@query("SELECT label, round(sum(v::DOUBLE), 6) AS sum, count(*) AS count, round(sum(v::DOUBLE) / count(*), 9) AS mean FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label")
def agg_nested_flatten(spark, sf_dir):
    return aggregates.flattened(table(spark, sf_dir, "embeddings"), "embedding", ["label"]).select("label", r("sum").alias("sum"), "count", r("mean", 9).alias("mean"))


@query("""
SELECT l_returnflag, sum(CASE WHEN n BETWEEN 0 AND 40 THEN n ELSE 0 END)::BIGINT AS photons, count(*) AS segments, sum(CASE WHEN inside AND n BETWEEN 0 AND 40 THEN n ELSE 0 END)::BIGINT AS photons_inside,
       count(*) FILTER (inside) AS segments_inside, count(*) FILTER (NOT n BETWEEN 0 AND 40) AS errors
FROM (SELECT l_returnflag, l_quantity::INTEGER AS n, l_discount > 0.05 AS inside FROM lineitem) GROUP BY ALL""")
def agg_masked_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("int"))
    return aggregates.masked_counts(li, ["l_returnflag"], "n", F.col("l_discount") > 0.05, 40)


@query(f"""
WITH {_TRACK_SQL}
SELECT user_id, min(us) AS t0, max(us) AS t1, arg_min(value, event_id) AS lat0, arg_min(x, event_id) AS lon0, arg_max(value, event_id) AS lat1, arg_max(x, event_id) AS lon1 FROM track GROUP BY user_id""")
def agg_resource_index(spark, sf_dir):
    return aggregates.resource_index(tracks(spark, sf_dir), "user_id", "event_id", "us", "x", "value")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_remove(spark, sf_dir):
    return aggregates.dedup(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "source", "lang")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def dedup_report(spark, sf_dir):
    return aggregates.dedup_report(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "source", "lang")


# --- windows along a track


@query(f"""
WITH {_WINDOWS_SQL}
SELECT user_id, extent, count(*) AS n, ((CASE WHEN max(x) - min(x) < 20 THEN 1 ELSE 0 END) | (CASE WHEN count(*) < 3 THEN 2 ELSE 0 END))::INTEGER AS pflags, round(avg(value), 6) AS value, round(min(x), 6) AS x0
FROM windows WHERE cls IN (1, 2, 3) GROUP BY ALL""")
def win_extent_explode(spark, sf_dir):
    w = extents.sliding(tracks(spark, sf_dir), TRACK, "x", LENGTH, STEP).where(F.col("cls").isin(1, 2, 3))
    return extents.summarise(w, TRACK, "x", [r(F.avg("value")).alias("value"), r(F.min("x")).alias("x0")], 3, 20.0, pass_invalid=True)


_ANCHORS_SQL = f"""
WITH RECURSIVE {_TRACK_SQL},
anchors AS (
  SELECT user_id, 0::BIGINT AS extent, min(x) AS start FROM track GROUP BY user_id
  UNION ALL
  SELECT a.user_id, a.extent + 1, min(t.x) FROM anchors a JOIN track t ON t.user_id = a.user_id AND t.x >= a.start + {STEP} GROUP BY a.user_id, a.extent)"""


@query(f"{_ANCHORS_SQL} SELECT a.user_id, extent, start, max(x) AS stop, count(*) AS n FROM anchors a JOIN track t ON t.user_id = a.user_id AND x >= start AND x < start + {LENGTH} GROUP BY ALL")
def win_extent_anchored(spark, sf_dir):
    return extents.anchored(tracks(spark, sf_dir), TRACK, "x", LENGTH, STEP)


@query(f"""
WITH {_TRACK_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 8 AS extent FROM track)
SELECT user_id, extent, count(*) AS n, round(max(value), 6) AS top FROM p GROUP BY ALL""")
def win_fixed_count(spark, sf_dir):
    return extents.fixed_count(tracks(spark, sf_dir), TRACK, ["us", "event_id"], 8).groupBy("user_id", "extent").agg(F.count("*").alias("n"), r(F.max("value")).alias("top"))


# --- algorithms

_SCALED = "x / 10000"


@query(f"""
WITH {_WINDOWS_SQL}, s AS (SELECT user_id, extent, {_SCALED} AS x, value AS h FROM windows)
SELECT user_id, extent, count(*) AS n, round(regr_slope(h, x), 4) AS slope, round(regr_intercept(h, x), 3) AS intercept
FROM s GROUP BY ALL HAVING count(*) >= 5""")
def fit_single_pass(spark, sf_dir):
    w = extents.sliding(tracks(spark, sf_dir), TRACK, "x", LENGTH, STEP).withColumn("xs", F.col("x") / 10000)
    out = w.groupBy("user_id", "extent").agg(F.count("*").alias("n"), *algorithms.single_pass_fit(F.col("xs"), F.col("value"))).where("n >= 5")
    return out.select("user_id", "extent", "n", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"))


@query()
def fit_iterative(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("x", F.col("x") / 10000)
    return algorithms.surface_fit(t, TRACK, "x", "value", LENGTH / 10000, STEP / 10000, least_rows=5, least_spread=5.0, sigma_max=200.0, pass_invalid=True)


_BIN = "least(floor((value - lo) / 10), greatest(ceil((hi - lo) / 10), 1) - 1)"


@query(f"""{_ANCHORS_SQL},
w AS (SELECT a.user_id, extent, x, value, cls FROM anchors a JOIN track t ON t.user_id = a.user_id AND x >= start AND x < start + {LENGTH}),
m AS (SELECT user_id, extent, median(x) AS x_atc, count(*) FILTER (cls = 1) AS soil, count(*) FILTER (cls IN (2, 3)) AS veg, median(value) FILTER (cls = 1) AS h_te_median,
             min(value) FILTER (cls IN (2, 3)) AS lo, max(value) FILTER (cls IN (2, 3)) AS hi, avg(value) FILTER (cls IN (2, 3)) AS mean, stddev_pop(value) FILTER (cls IN (2, 3)) AS std FROM w GROUP BY ALL),
b AS (SELECT user_id, extent, {_BIN} AS bin, count(*) AS n, max(value) AS top, any_value(veg) AS veg FROM w JOIN m USING (user_id, extent) WHERE cls IN (2, 3) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id, extent ORDER BY bin) / veg * 100 AS share FROM b),
p AS (SELECT user_id, extent, min(top) FILTER (share >= 98) AS h_canopy, min(top) FILTER (share >= 50) AS h_50 FROM c GROUP BY ALL)
SELECT user_id, extent, round(x_atc, 7) AS x_atc, soil::INTEGER AS ground, veg::INTEGER AS vegetation, round(h_te_median, 6) AS h_te_median, hi AS h_max, lo AS h_min, round(mean, 9) AS h_mean, round(std, 5) AS openness, h_canopy, h_50
FROM m LEFT JOIN p USING (user_id, extent)""")
def canopy_metrics(spark, sf_dir):
    out = algorithms.canopy_metrics(tracks(spark, sf_dir), TRACK, "x", "value", "cls", "value", LENGTH, STEP, 10.0)
    real = lambda c, name, digits=6: r(F.when(~F.isnan(c), F.col(c) if isinstance(c, str) else c), digits).alias(name)
    fifty = F.col("canopy_h_metrics")[algorithms.PERCENTILES.index(50)]
    return out.select("user_id", "extent", r("x_atc", 7).alias("x_atc"), F.col("ground_photon_count").alias("ground"), F.col("vegetation_photon_count").alias("vegetation"), real("h_te_median", "h_te_median"), real("h_max_canopy", "h_max"), real("h_min_canopy", "h_min"), real("h_mean_canopy", "h_mean", 9), real("canopy_openness", "openness", 5), real("h_canopy", "h_canopy"), real(fifty, "h_50"))


@query(f"""
WITH {_WINDOWS_SQL},
g AS (SELECT user_id, extent, count(*) AS n, count(*) FILTER (cls = 3) AS n3, count(*) FILTER (cls IN (2, 3)) AS n23, count(*) FILTER (cls = 1) AS n1,
             quantile_cont(value, 0.98) FILTER (cls = 3) AS q3, quantile_cont(value, 0.98) FILTER (cls IN (2, 3)) AS q23, quantile_cont(value, 0.98) FILTER (cls = 1) AS q1, quantile_cont(value, 0.5) FILTER (cls = 1) AS m1
      FROM windows GROUP BY ALL)
SELECT user_id, extent, n, round(CASE WHEN n3 >= 3 THEN q3 WHEN n23 >= 3 THEN q23 WHEN n1 >= 3 THEN q1 END, 6) AS top_of_surface, round(CASE WHEN n1 >= 3 THEN m1 END, 6) AS median_ground,
       (CASE WHEN (n3 >= 3 OR n23 >= 3 OR n1 >= 3) AND n1 >= 3 THEN 0 ELSE 2 END)::INTEGER AS surface_flags
FROM g""")
def blanket_surface(spark, sf_dir):
    w = extents.sliding(tracks(spark, sf_dir), TRACK, "x", LENGTH, STEP)
    out = w.groupBy("user_id", "extent").agg(F.count("*").alias("n"), *algorithms.blanket(F.col("cls"), F.col("value"), 3))
    real = lambda c: r(F.when(~F.isnan(c), F.col(c))).alias(c)
    return out.select("user_id", "extent", "n", real("top_of_surface"), real("median_ground"), "surface_flags")


@query(f"""
WITH {_TRACK_SQL}, t AS (SELECT event_id, user_id, x / 3600 AS x, value AS h FROM track),
g AS (SELECT a.event_id, a.user_id, a.x, abs(b.h - a.h) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.h - a.h)) AS i, count(*) OVER (PARTITION BY a.event_id) AS n
      FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(b.x - a.x) <= 12 AND abs(b.h - a.h) <= 50),
w AS (SELECT event_id, sum(50 - gap) FILTER (i <= greatest(floor(sqrt(n)), 5)) AS w, greatest(any_value(floor(sqrt(n))), 5) AS k FROM g GROUP BY event_id),
s AS (SELECT t.event_id, t.user_id, coalesce(w.w, 0) AS w, max(coalesce(w.k, 5)) OVER (PARTITION BY t.user_id) AS k FROM t LEFT JOIN w USING (event_id))
SELECT event_id, user_id, floor(least(w / (50 * k) * 255, 255))::INTEGER AS score FROM s""")
def yapc_v3(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("x", F.col("x") / 3600)
    return algorithms.density_score(t, TRACK, "user_id", "x", "value", ["us"], 24.0, 100.0).select("event_id", "user_id", "score")


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS depth, pi() / 2 - (1.0 + l_discount) AS theta, l_tax * 10 AS az, l_linenumber AS cls FROM lineitem),
a AS (SELECT *, asin(1.00029 * sin(theta) / 1.34116) AS below, depth / cos(theta) AS s FROM d),
b AS (SELECT *, s * (1.00029 / 1.34116) AS rr, theta - below AS turn FROM a),
p AS (SELECT *, sqrt(rr * rr + s * s - 2 * rr * s * cos(turn)) AS p FROM b),
z AS (SELECT *, pi() / 2 - theta - asin(rr * sin(turn) / p) AS beta FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN cls <> 7 THEN p * sin(beta) ELSE 0 END, 6) AS dz, round(CASE WHEN cls <> 7 THEN p * cos(beta) * sin(az) ELSE 0 END, 6) AS de, round(CASE WHEN cls <> 7 THEN p * cos(beta) * cos(az) ELSE 0 END, 6) AS dn FROM z""")
def bathy_refraction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("surface"), (-F.col("l_quantity") / 10).alias("h"), (1.0 + F.col("l_discount")).alias("elevation"), (F.col("l_tax") * 10).alias("az"))
    out = algorithms.refracted(li, "h", "surface", "elevation", "az", "l_linenumber", 7)
    return out.select("l_orderkey", "l_linenumber", r("dz").alias("dz"), r("de").alias("de"), r("dn").alias("dn"))


@query()
def bathy_surface(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("rate", F.lit(0.0))
    return algorithms.sea_surface(t, TRACK, ["us", "event_id"], "value", "x", "rate", 64, binsize=20.0)


@query()
def bathy_signal(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("xs", F.col("x") / 50_000).select("event_id", "user_id", "xs", "value")
    return algorithms.with_signal_strength(t, TRACK, "xs", "value")


# --- rasters: customers are the pixels of a raster of 40 columns, orders the points


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(k % 17 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40 + 0.25).alias("x"), (-F.floor(F.col("o_custkey") / 40) - 0.5).alias("y"))
    return raster.pixel_of(o, "x", "y", 0.0, 0.0, 1.0, 1.0)


_PIXELS_SQL = """
pixels AS (SELECT (c_custkey // 40)::INTEGER AS row, (c_custkey % 40)::INTEGER AS col, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS value FROM customer),
points AS (SELECT o_orderkey, (o_custkey // 40)::INTEGER AS row, (o_custkey % 40)::INTEGER AS col FROM orders)"""


@query(f"WITH {_PIXELS_SQL} SELECT o_orderkey, row, col, value FROM points JOIN pixels USING (row, col)")
def raster_nearest(spark, sf_dir):
    found = raster.nearest(points(spark, sf_dir), pixels(spark, sf_dir))
    return found.select("o_orderkey", "row", "col", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(f"""
WITH {_PIXELS_SQL},
v AS (SELECT o_orderkey, pixels.value AS value FROM points JOIN pixels ON pixels.row BETWEEN points.row - 2 AND points.row + 2 AND pixels.col BETWEEN points.col - 2 AND points.col + 2
      WHERE pow(pixels.row - points.row, 2) + pow(pixels.col - points.col, 2) <= 4 AND value IS NOT NULL),
m AS (SELECT *, avg(value) OVER (PARTITION BY o_orderkey) AS mu FROM v)
SELECT o_orderkey, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 4) AS stdev, round(avg(abs(value - mu)), 9) AS mad FROM m GROUP BY o_orderkey""")
def raster_zonal(spark, sf_dir):
    z = raster.zonal(points(spark, sf_dir), pixels(spark, sf_dir), ["o_orderkey"], raster.radius_in_pixels(2.0, 1.0, 1.0))
    return z.select("o_orderkey", "count", "min", "max", r("mean").alias("mean"), r("median").alias("median"), r("stdev", 4).alias("stdev"), r("mad", 9).alias("mad"))


@query(f"""
WITH {_PIXELS_SQL},
v AS (SELECT o_orderkey, pixels.value AS v, pixels.row - points.row AS dr, pixels.col - points.col AS dc FROM points JOIN pixels ON pixels.row BETWEEN points.row - 1 AND points.row + 1 AND pixels.col BETWEEN points.col - 1 AND points.col + 1 WHERE value IS NOT NULL),
g AS (SELECT o_orderkey, count(*) AS count, sum(w * v * dc) / nullif(sum(w * abs(dc)) * 30.0, 0) AS gx, sum(w * v * dr) / nullif(sum(w * abs(dr)) * 30.0, 0) AS gy FROM (SELECT *, CASE WHEN dr = 0 OR dc = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM v) GROUP BY o_orderkey)
SELECT o_orderkey, count, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(CASE WHEN gx = 0 AND gy = 0 THEN 0 WHEN degrees(atan2(gy, -gx)) < 0 THEN degrees(atan2(gy, -gx)) + 360 ELSE degrees(atan2(gy, -gx)) END, 4) AS aspect FROM g""")
def raster_slope(spark, sf_dir):
    s = raster.slope_aspect(points(spark, sf_dir), pixels(spark, sf_dir), ["o_orderkey"], 30.0)
    return s.select("o_orderkey", "count", r("slope", 5).alias("slope"), r("aspect", 4).alias("aspect"))


@query(f"""
WITH {_PIXELS_SQL},
v AS (SELECT o_orderkey, pixels.value AS v, pixels.row - points.row AS dr, pixels.col - points.col AS dc FROM points JOIN pixels ON pixels.row BETWEEN points.row - 1 AND points.row + 1 AND pixels.col BETWEEN points.col - 1 AND points.col + 1 WHERE value IS NOT NULL),
w AS (SELECT *, greatest(1 - abs(dr), 0) * greatest(1 - abs(dc + 0.25), 0) AS w FROM v)
SELECT o_orderkey, count(*) = 9 AS resampled, round(CASE WHEN count(*) = 9 THEN sum(w * v) / sum(w) ELSE max(CASE WHEN dr = 0 AND dc = 0 THEN v END) END, 5) AS value FROM w GROUP BY o_orderkey""")
def raster_resample(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("fr", -F.col("y")).withColumn("fc", F.col("x"))
    out = raster.resample(p, pixels(spark, sf_dir), ["o_orderkey"], "bilinear")
    return out.select("o_orderkey", "resampled", r("value", 5).alias("value"))


@query("SELECT (c_custkey // 40)::INTEGER AS row, (c_custkey % 40)::INTEGER AS col FROM customer WHERE c_custkey // 40 BETWEEN 5 AND 14 AND c_custkey % 40 BETWEEN 10 AND 19")
def raster_subset(spark, sf_dir):
    return raster.subset(pixels(spark, sf_dir), 5, 15, 10, 20).select("row", "col")


@query("""
WITH b AS (SELECT l_orderkey, any_value(l_extendedprice) FILTER (l_linenumber = 1) AS green, any_value(l_extendedprice) FILTER (l_linenumber = 2) AS red, any_value(l_extendedprice) FILTER (l_linenumber = 3) AS nir, any_value(l_extendedprice) FILTER (l_linenumber = 4) AS swir
           FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 4 GROUP BY l_orderkey)
SELECT l_orderkey, round((green - swir) / (green + swir), 6) AS ndsi, round((nir - red) / (nir + red), 6) AS ndvi, round((nir - swir) / (nir + swir), 6) AS ndwi FROM b""")
def raster_indices(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = aggregates.band_indices(li, ["l_orderkey"], "l_linenumber", "l_extendedprice", {"green": 1, "red": 2, "nir": 3, "swir": 4})
    return out.select("l_orderkey", *[r(c).alias(c) for c in ("ndsi", "ndvi", "ndwi")])


@query("""
WITH c AS (SELECT user_id, event_id, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) AS gap FROM events WHERE dayofyear(ts) BETWEEN 2 AND 28 AND contains(event_type, 'c'))
SELECT user_id, event_id FROM c QUALIFY rank() OVER (PARTITION BY user_id ORDER BY gap) = 1""")
def raster_closest_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = raster.named(e, "c", "event_type").where(times.in_day_range(F.col("ts"), "2:28"))
    return raster.closest_in_time(e, TRACK, "ts", F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_id")


@query("""
WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, v[1] AS first, v[len(v)] AS last, list_min(v) AS min, list_max(v) AS max, round(list_avg(v), 6) AS mean, list_sort(v)[len(v) // 2 + 1] AS median FROM l""")
def raster_single_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lists = raster.sample_lists(e, TRACK, ["value"], ["ts", "event_id"], "dem").withColumnRenamed("dem.value", "v")
    one = lambda how: aggregates.single_sample("v", how)
    return lists.select("user_id", *[one(h).alias(h) for h in ("first", "last", "min", "max")], r(one("mean")).alias("mean"), one("median").alias("median"))


@query("""
WITH p AS (SELECT o_orderkey, o_custkey % 100 * 1.0::DOUBLE AS x, o_orderkey % 50 * 1.0::DOUBLE AS y FROM orders),
c AS (SELECT s_suppkey AS raster, s_suppkey % 10 * 10.0::DOUBLE AS x0, s_nationkey * 2.0::DOUBLE AS y0, s_suppkey % 10 * 10.0::DOUBLE + 15 AS x1, s_nationkey * 2.0::DOUBLE + 5 AS y1 FROM supplier)
SELECT o_orderkey, count(*) AS n, sum(raster)::BIGINT AS total FROM p JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY o_orderkey""")
def raster_covering(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100 * 1.0).alias("x"), (F.col("o_orderkey") % 50 * 1.0).alias("y"))
    x0, y0 = F.col("s_suppkey") % 10 * 10.0, F.col("s_nationkey") * 2.0
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("raster"), x0.alias("x0"), y0.alias("y0"), (x0 + 15).alias("x1"), (y0 + 5).alias("y1"))
    return raster.covering(p, c, "x", "y", 10.0).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("raster").alias("total"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 100 AS lon, c_nationkey * 3.5::DOUBLE - 40 AS lat FROM customer)
SELECT c_custkey, floor(lon / 5) * 5 AS tile_x, ceil(lat / 5) * 5 AS tile_y, (least(floor((90 - lat) * 24), 4319) * 8640 + least(floor((lon + 180) * 24), 8639))::BIGINT AS cell FROM c""")
def raster_tile_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_nationkey") * 3.5 - 40).alias("lat"))
    x, y = raster.tile_of(F.col("lon"), F.col("lat"))
    return c.select("c_custkey", x.cast("double").alias("tile_x"), y.cast("double").alias("tile_y"), raster.grid_index(F.col("lon"), F.col("lat")).alias("cell"))


# --- sets and order


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS srcid, CASE o_orderstatus WHEN 'F' THEN 'f.h5' WHEN 'O' THEN 'o.h5' ELSE 'p.h5' END AS source FROM orders")
def union_srcid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows, names = readers.numbered_sources({f"{s.lower()}.h5": o.where(F.col("o_orderstatus") == s).select("o_orderkey") for s in "FOP"})
    return rows.join(F.broadcast(names), "srcid").select("o_orderkey", "srcid", "source")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def sort_interleave(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    merged = readers.interleave([e.where(F.col("event_type") == k) for k in CLASSES if k != "view"], "ts", ["event_id"], at("2024-01-05"), at("2024-01-20"))
    return columns.with_index(merged, "pos", ["ts", "event_id"]).select("event_id", "pos")


# --- functions


@query(r"""
SELECT doc_id, upper(source) AS up, base64(encode(source)) AS b64, hex(encode(source)) AS b16, strpos(source, 'c') - 1 AS at, strpos(source, 'c') - 1 AS at_last, TRY_CAST(source[4:] AS BIGINT) AS num,
       replace(source, 'src', 'x') AS swapped, len(string_split(coalesce(text, ''), ' '))::INTEGER AS parts, regexp_replace(coalesce(text, ''), '[^\x20-\x7E]', '', 'g') = coalesce(text, '') AS plain
FROM documents""")
def str_fn(spark, sf_dir):
    d, s = table(spark, sf_dir, "documents"), F.col("source")
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.upper(s).alias("up"), F.base64(s.cast("binary")).alias("b64"), F.hex(s.cast("binary")).alias("b16"), text.find(s, "c").cast("long").alias("at"), text.find(s, "c", last=True).cast("long").alias("at_last"), text.to_long(F.substring(s, 4, 99)).alias("num"), F.replace(s, F.lit("src"), F.lit("x")).alias("swapped"), F.size(F.split(t, " ", -1)).alias("parts"), (text.printable(t) == t).alias("plain"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, translate(base64(encode(props)), '+/', '-_') AS url64, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS line FROM events")
def json_fn(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.base64_url(F.col("props").cast("binary")).alias("url64"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("line"))


@query("""
SELECT event_id, year(ts)::INTEGER AS year, dayofyear(ts)::INTEGER AS doy, hour(ts)::INTEGER AS hour, day(last_day(ts))::INTEGER AS days, strftime(ts, '%b') AS month,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) % 1000000 // 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 - 315964800000 + 18000 AS gps_ms, epoch_us(ts) // 1000000 * 1000000000 AS ns
FROM events""")
def time_fn(spark, sf_dir):
    e, ts = table(spark, sf_dir, "events"), F.col("ts")
    parts = times.gmt(ts)
    gps = times.unix_ns_to_gps_ms(times.micros(ts) * 1000)
    seconds = F.floor(times.unix_ns_to_gps_ms(times.micros(ts) * 1000) / 1000)
    return e.select("event_id", parts["year"].alias("year"), parts["doy"].alias("doy"), parts["hour"].alias("hour"), times.days_in_month(ts).alias("days"), times.month_name(ts).alias("month"), times.iso(ts).alias("iso"), gps.alias("gps_ms"), times.gps_to_unix_ns(seconds.cast("double")).alias("ns"))


# --- streams


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("SELECT event_id, user_id, 'value' AS limit_field, value AS limit_value FROM events WHERE (value < 20 OR value > 470) AND event_type = 'error'")
def stream_limit(spark, sf_dir):
    return dispatch.drain(dispatch.limit(stream(spark, sf_dir), "value", 20.0, 470.0, "event_type", "error")).select("event_id", "user_id", "limit_field", "limit_value")


@query("SELECT value AS key, unnest(['events.event_id', 'events.user_id']) AS name, unnest([event_id::DOUBLE, user_id::DOUBLE]) AS value FROM events WHERE value BETWEEN 100 AND 400")
def stream_metric(spark, sf_dir):
    return dispatch.drain(dispatch.metric(stream(spark, sf_dir), "value", ["event_id", "user_id"], "events", 100, 400))


@query("SELECT user_id AS key, max(value) AS \"value\", max(event_id)::DOUBLE AS event_id FROM events GROUP BY user_id")
def stream_report(spark, sf_dir):
    metrics = dispatch.metric(stream(spark, sf_dir), "user_id", ["value", "event_id"], "m")
    return dispatch.drain(dispatch.report(metrics, ["m.value", "m.event_id"]).toDF("key", "value", "event_id"), "complete")


@query("SELECT 'value:' || value::VARCHAR AS captured FROM events WHERE event_type = 'signup' AND value IS NOT NULL")
def stream_capture(spark, sf_dir):
    return dispatch.drain(dispatch.capture(stream(spark, sf_dir), "value", "event_type", "signup"))


@query("SELECT event_id || ', ' || event_type || ', ' || user_id AS line FROM events")
def stream_csv(spark, sf_dir):
    return dispatch.drain(dispatch.csv(stream(spark, sf_dir), ["event_id", "event_type", "user_id"]))


@query("SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS offset FROM events")
def stream_key_offset(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("us", times.micros(F.col("ts")))
    return dispatch.drain(dispatch.first_key_offset(s, "user_id", "us"))




@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = dispatch.drain(dispatch.tumbling(s, "at", "6 hours", ["event_type"], [F.count("*").alias("n"), r(F.sum("value"), 4).alias("total")]), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL '3 hours']) AS start FROM events)
SELECT event_type, start, start + INTERVAL '6 hours' AS "end", count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = dispatch.drain(dispatch.sliding(s, "at", "6 hours", "3 hours", ["event_type"], [F.count("*").alias("n")]), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""
WITH o AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL '4 hours', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '4 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    s = stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = dispatch.drain(dispatch.sessions(s, "at", "4 hours", ["user_id"], [F.count("*").alias("n")]), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# --- sinks and catalogs


@query("SELECT s_suppkey, s_nationkey * 10.0::DOUBLE - 120 AS longitude, s_acctbal / 200 AS latitude FROM supplier")
def sink_geoparquet(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 10.0 - 120).alias("longitude"), (F.col("s_acctbal") / 200).alias("latitude"))
    folder = dispatch.shared_folder(spark)
    sinks.write(s, sinks.Output(f"{folder}/geo", "geoparquet"))
    return readers.points(spark, f"{folder}/geo").select("s_suppkey", "longitude", "latitude")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_csv(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    folder = dispatch.shared_folder(spark)
    sinks.write(s, sinks.Output(f"{folder}/csv", "csv"))
    return spark.read.schema(s.schema).csv(f"{folder}/csv", header=True)


@query("""
SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice >= 1000 AND o_totalprice <= 200000 AND n_name LIKE '%A%' AND o_orderstatus = 'O'""")
def catalog_ams(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    found = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    conditions = [catalog.time_filter("o_orderdate", "1996-01-01", None), catalog.number_filter("o_totalprice", 1000, 200000), catalog.name_filter("n_name", "A"), F.col("o_orderstatus") == "O"]
    return catalog.search(found, conditions).select("o_orderkey", "n_name")


