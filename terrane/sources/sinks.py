"""Sinks: Parquet with metadata, GeoParquet, CSV, Feather, LAS."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators.columns import projected

ROW_GROUP_ROWS = 500_000


@dataclass
class Output:
    path: str
    format: str = "parquet"
    fields: list[str] | None = None
    x: str = "longitude"
    y: str = "latitude"
    z: str = "height"
    time: str = "time_ns"
    crs: str = "EPSG:7912"
    meta: dict = field(default_factory=dict)
    with_schema: bool = False


def with_geometry(df: DataFrame, x: str, y: str) -> DataFrame:
    """x and y replaced by `geometry`, a point's well-known binary."""
    return df.withColumn("geometry", geo.wkb_point(F.col(x).cast("double"), F.col(y).cast("double"))).drop(x, y)


def geo_metadata(crs: str) -> dict:
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"], "crs": crs}}}


def openapi(df: DataFrame) -> dict:
    """Names and types of a table as an OpenAPI object."""
    kinds = {"double": ("number", "double"), "float": ("number", "float"), "bigint": ("integer", "int64"), "int": ("integer", "int32"), "smallint": ("integer", "int16"), "tinyint": ("integer", "int8"), "string": ("string", None), "boolean": ("boolean", None), "binary": ("string", "byte")}
    one = lambda t: {"type": kinds.get(t, ("string", None))[0]} | ({"format": f} if (f := kinds.get(t, ("", t))[1]) else {})
    return {"type": "object", "properties": {n: {"type": "array", "items": one(t[6:-1])} if t.startswith("array<") else one(t) for n, t in df.dtypes}}


def write(df: DataFrame, out: Output) -> DataFrame:
    """Writes df in the output's format and returns what was written, before encoding."""
    if out.fields is not None:
        df = projected(df, out.fields, [out.time])
    if out.format in ("parquet", "geoparquet"):
        shaped = with_geometry(df, out.x, out.y) if out.format == "geoparquet" else df
        meta = dict(out.meta) | ({"geo": geo_metadata(out.crs)} if out.format == "geoparquet" else {}) | ({"openapi": openapi(df)} if out.with_schema else {})
        shaped.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROW_GROUP_ROWS * 20).parquet(out.path)
        if meta:  # a table of keys beside the data, as Spark's writers set no footer keys
            df.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{out.path}/_metadata_keys")
    elif out.format == "csv":
        df.write.mode("overwrite").csv(out.path, header=True)
    elif out.format == "feather":
        write_feather(df, out.path)
    elif out.format == "las":
        write_las(df, out)
    else:
        raise ValueError(f"unsupported format {out.format!r}")
    return df


def write_feather(df: DataFrame, path: str) -> None:
    """One Arrow file for each partition, written by the tasks; path is a shared folder."""
    import os

    os.makedirs(path, exist_ok=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c = TaskContext.get()
        name, writer, n = f"{path}/part-{c.partitionId():05d}.arrow", None, 0
        for b in batches:
            if writer is None:
                writer = pa.ipc.new_file(f"{name}.{c.attemptNumber()}", b.schema)
            writer.write_batch(b)
            n += b.num_rows
        if writer is not None:
            writer.close()
            os.replace(f"{name}.{c.attemptNumber()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["rows"])

    df.mapInArrow(run, "rows long").collect()


def las_scaling(lo: float, hi: float) -> tuple[float, float]:
    """Scale and offset that spread an axis over 32-bit whole numbers."""
    return ((hi - lo) / (2**31 - 2) or 1.0), lo


def write_las(df: DataFrame, out: Output) -> None:
    """A LAS 1.2 file, point format 0. Rows come to the driver one partition after the other and are never held together."""
    b = df.agg(*[f(c).alias(f"{n}{k}") for k, c in zip("xyz", (out.x, out.y, out.z), strict=True) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    if not b["n"]:
        raise ValueError("no rows to write")
    scaling = [las_scaling(float(b[f"lo{k}"]), float(b[f"hi{k}"])) for k in "xyz"]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, bytes(8), 1, 2, b"OTHER", b"terrane", 1, 2024, 227, 227, 0, 0, 20, b["n"], b["n"], 0, 0, 0, 0)
    head += struct.pack("<6d", *[s for s, _ in scaling], *[o for _, o in scaling])
    head += struct.pack("<6d", *[float(b[f"{n}{k}"]) for k in "xyz" for n in ("hi", "lo")])
    with open(out.path, "wb") as f:
        f.write(head)
        for row in df.select(F.col(out.x).cast("double"), F.col(out.y).cast("double"), F.col(out.z).cast("double")).toLocalIterator():
            f.write(struct.pack("<3iHBBbBH", *[round((v - o) / s) for v, (s, o) in zip(row, scaling, strict=True)], 0, 9, 0, 0, 0, 0))


def read_las(path: str) -> np.ndarray:
    """x, y, z of a file that write_las made."""
    with open(path, "rb") as f:
        data = f.read()
    n, = struct.unpack_from("<I", data, 107)
    scale, offset = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    raw = np.frombuffer(data, np.dtype([("xyz", "<i4", 3), ("rest", "V8")]), n, 227)
    return raw["xyz"] * scale + offset
