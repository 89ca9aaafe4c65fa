"""Times headline queries: one JSON line. Rows are counted by a sink that takes every column of every row."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + (":" + os.environ["PYTHONPATH"] if os.environ.get("PYTHONPATH") else "")

HEADLINE = (
    "flt_polygon_raycast", "flt_contiguous_extent", "prj_computed_columns", "join_merge_left", "join_asof_clamped", "join_interpolate",
    "agg_ancillary_dsl", "agg_median_mode", "dedup_remove", "win_extent_explode", "fit_single_pass", "fit_iterative", "blanket_surface",
    "canopy_metrics", "yapc_v3", "bathy_refraction", "raster_nearest", "raster_zonal", "raster_slope", "union_srcid", "stream_tumbling",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from terrane.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
