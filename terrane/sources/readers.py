"""Readers of staged arrays, catalogs, point files, JSON regions and fixed-layout packets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geo


def dataset(spark: SparkSession, path: str, variable: str, start: int = 0, rows: int | None = None, order: str = "pos") -> DataFrame:
    """One variable of a staged file, a range of its rows: the range is a condition on `pos`, which prunes row groups."""
    df = spark.read.parquet(path).where(F.col(order) >= start)
    if rows is not None:
        df = df.where(F.col(order) < start + rows)
    return df.select(order, variable)


def datasets(spark: SparkSession, path: str, variables: list[str], groups: list[str] | None = None, index: str | None = None) -> DataFrame:
    """Several variables as one table; groups are values of the partition column `group`."""
    df = spark.read.parquet(path)
    if groups is not None:
        df = df.where(F.col("group").isin(groups))
    keep = [c for c in ("group", index) if c and c in df.columns]
    return df.select(*keep, *[v for v in variables if v not in keep])


def inspect(df: DataFrame) -> DataFrame:
    """Names and types of a table's columns."""
    return df.sparkSession.createDataFrame([(k, n, t) for k, (n, t) in enumerate(df.dtypes)], "position int, name string, type string")


def points(spark: SparkSession, path: str, geometry: str = "geometry", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """A Parquet file of points with x and y, or with well-known binary."""
    df = spark.read.parquet(path)
    if x in df.columns and y in df.columns:
        return df
    return df.withColumn("_p", geo.wkb_xy(geometry)).withColumn(x, F.col("_p.x")).withColumn(y, F.col("_p.y")).drop("_p")


def asset_directory(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file: comma-separated, with a header."""
    return spark.read.csv(path, header=True, inferSchema=True)


def region(source: str | list | dict) -> list[tuple[float, float]]:
    """The first outer ring of GeoJSON (text or object), a list of points, or a box [x0, y0, x1, y1]."""
    if isinstance(source, str):
        source = json.loads(source)
    if isinstance(source, dict):
        kind = source["type"]
        if kind == "FeatureCollection":
            return region(source["features"][0])
        if kind == "Feature":
            return region(source["geometry"])
        ring = source["coordinates"][0] if kind == "Polygon" else source["coordinates"][0][0]
        return geo.clean_ring(ring)
    if len(source) == 4 and all(isinstance(v, int | float) for v in source):
        x0, y0, x1, y1 = source
        return geo.clean_ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    return geo.clean_ring([(p["lon"], p["lat"]) if isinstance(p, dict) else tuple(p) for p in source])


PACKET_SCHEMA = "source string, offset long, apid int, type int, has_secondary boolean, segmentation int, sequence int, length int, seconds double, valid boolean, payload binary"


def parse_packets(data: bytes, source: str = "", strip: int = 0, trailer: int = 0) -> Iterator[tuple]:
    """Space packets in a byte stream: each has a six-byte header, big-endian; `strip` bytes before and `trailer` bytes after each packet are skipped.

    valid: the packet is whole and its sequence number follows the last one of its application id.
    """
    at, last = 0, {}
    while at + strip + 6 <= len(data):
        h = at + strip
        word, seq, size = int.from_bytes(data[h : h + 2]), int.from_bytes(data[h + 2 : h + 4]), int.from_bytes(data[h + 4 : h + 6]) + 7
        apid, number = word & 0x7FF, seq & 0x3FFF
        whole = h + size <= len(data)
        follows = apid not in last or (last[apid] + 1) & 0x3FFF == number
        last[apid] = number
        body = data[h + 6 : h + size]
        second = bool(word >> 11 & 1)
        seconds = int.from_bytes(body[:4]) + int.from_bytes(body[4:6]) / 65536 if second and len(body) >= 6 else None
        yield source, at, apid, word >> 12 & 1, second, seq >> 14, number, size, seconds, whole and follows, body
        at = h + size + trailer


def packets(files: DataFrame, apids: list[int] | None = None, strip: int = 0, trailer: int = 0) -> DataFrame:
    """Packets of a table (path, content) as spark.read.format("binaryFile") gives it; a file is one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows: list[tuple] = []
                for row in parse_packets(content or b"", path, strip, trailer):
                    if apids is None or row[2] in apids:
                        rows.append(row)
                    if len(rows) == 10_000:
                        yield _packet_batch(rows)
                        rows = []
                if rows:
                    yield _packet_batch(rows)

    return files.select("path", "content").mapInArrow(run, PACKET_SCHEMA)


def _packet_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def packet_fields(df: DataFrame, layout: dict[str, tuple[int, int]]) -> DataFrame:
    """Unsigned big-endian fields of the payload: name to (first byte, number of bytes up to seven)."""
    at = lambda start, n: F.conv(F.hex(F.substring("payload", start + 1, n)), 16, 10).cast("long")
    return df.withColumns({k: at(*v) for k, v in layout.items()})


def checksum(payload: bytes) -> int:
    """Exclusive or of all bytes."""
    return int(np.bitwise_xor.reduce(np.frombuffer(payload, np.uint8), initial=0))


def packet_stats(df: DataFrame) -> DataFrame:
    """Counts, bytes, invalid packets and mean length for each application id."""
    return df.groupBy("apid").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_if(~F.col("valid")).alias("invalid"), F.avg("length").alias("mean_length"))


def interleave(frames: list[DataFrame], time: str, order: list[str], start: object = None, stop: object = None) -> DataFrame:
    """All rows of the frames between start and stop, in order of time. The sort is by ranges, in as many tasks as needed."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start))
    if stop is not None:
        out = out.where(F.col(time) <= F.lit(stop))
    return out.orderBy(time, *order)


def numbered_sources(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All rows of named frames with `srcid`, and the table of ids. Frames must agree in names and types."""
    first = next(iter(frames.values()))
    for name, f in frames.items():
        if dict(f.dtypes) != dict(first.dtypes):
            raise ValueError(f"the columns of {name} differ from those of the first source")
    out = None
    for k, f in enumerate(frames.values()):
        part = f.withColumn("srcid", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out, first.sparkSession.createDataFrame(list(enumerate(frames)), "srcid int, source string")


def window_rank(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def packetize(df: DataFrame, payload: str, apid: int, sequence: str) -> DataFrame:
    """df with `packet`: the payload behind a telemetry header with a sequence number modulo 2 ** 14."""
    number = F.pmod(F.col(sequence), F.lit(1 << 14))
    two = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0"))
    head = F.concat(two(F.lit(apid & 0x7FF)), two(number + 0xC000), two(F.length(payload) - 1))
    return df.withColumn("packet", F.concat(head, F.col(payload)))


def forward(packets_: DataFrame, apids: list[int], length: int | None = None, check: bool = False) -> DataFrame:
    """Payloads of the listed ids; of one length if asked; whose last byte makes their exclusive or zero if asked."""
    out = packets_.where(F.col("apid").isin(apids))
    if length is not None:
        out = out.where(F.length("payload") == length)
    if check:
        hexed = F.hex("payload")
        byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, 2), 16, 10).cast("int")
        total = F.aggregate(F.sequence(F.lit(0), F.length("payload") - 1), F.lit(0), lambda a, i: a.bitwiseXOR(byte(i)))
        out = out.where(total == 0)
    return out.select("apid", "sequence", "payload")
