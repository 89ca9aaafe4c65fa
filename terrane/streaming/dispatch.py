"""Record streams: limits, metrics, reports, captures, key offsets and event-time windows.

Every function takes a DataFrame, streaming or not, and returns one, so a stream and its replay are the same plan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from terrane.sources import scratch


def unpack(df: DataFrame, records: str) -> DataFrame:
    """A row for each record of a container column; the container's other columns stay beside it."""
    others = [c for c in df.columns if c != records]
    return df.select(*others, F.inline(records))


def route(df: DataFrame, kind: str, wanted: str) -> DataFrame:
    """Records of one type."""
    return df.where(F.col(kind) == wanted)


def keyed(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("key", key)


def limit(df: DataFrame, field: str, least: float | None = None, most: float | None = None, id_column: str | None = None, record_id: object = None) -> DataFrame:
    """Records whose field is out of bounds, either of which may be open."""
    out = F.lit(False)
    if least is not None:
        out = out | (F.col(field) < least)
    if most is not None:
        out = out | (F.col(field) > most)
    if id_column is not None and record_id is not None:
        df = df.where(F.col(id_column) == record_id)
    return df.where(out).withColumn("limit_field", F.lit(field)).withColumn("limit_value", F.col(field).cast("double"))


def metric(df: DataFrame, key: str, fields: list[str], source: str = "record", key_min: object = None, key_max: object = None, ids: list | None = None, id_column: str | None = None, with_text: bool = False) -> DataFrame:
    """(key, name, value) of each field of each record; keys outside the closed range are left out."""
    if ids is not None and id_column is not None:
        df = df.where(F.col(id_column).isin(ids))
    if key_min is not None:
        df = df.where(F.col(key) >= key_min)
    if key_max is not None:
        df = df.where(F.col(key) <= key_max)
    rows = F.array(*[F.struct(F.lit(f"{source}.{f}").alias("name"), F.col(f).cast("double").alias("value"), *([F.col(f).cast("string").alias("text")] if with_text else [])) for f in fields])
    return df.select(F.col(key).alias("key"), F.inline(rows))


def matching(df: DataFrame, wanted: dict[str, object], enable: bool = True) -> DataFrame:
    """Records all of whose listed fields have these values, or, with enable off, do not."""
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & (F.col(k) == F.lit(v))
    return df.where(hit if enable else ~hit)


def report(metrics: DataFrame, names: list[str] | None = None, combine=F.max) -> DataFrame:
    """One row for each key: a column for each of `names`, or a map of all names."""
    if names is None:
        pairs = F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value"))))
        return metrics.groupBy("key").agg(pairs.alias("values"))
    return metrics.groupBy("key").agg(*[combine(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def capture(df: DataFrame, field: str, id_column: str | None = None, record_id: object = None) -> DataFrame:
    """`field:value` of the records that hold the field."""
    if id_column is not None and record_id is not None:
        df = df.where(F.col(id_column) == record_id)
    return df.where(F.col(field).isNotNull()).select(F.concat(F.lit(f"{field}:"), F.col(field).cast("string")).alias("captured"))


def csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line for each record, separated by comma and blank; nulls are empty."""
    return df.select(F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def first_key_offset(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, offset): keys counted from the first one that its group showed; earlier ones are 0.

    The first key of a group is kept as state from batch to batch.
    """
    kind = dict(df.dtypes)[by]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        first = state.get[0] if state.exists else int(rows[key].min())
        state.update((first,))
        yield pd.DataFrame({by: group[0], key: rows[key], "offset": (rows[key] - first).clip(lower=0)})

    return df.select(by, F.col(key).cast("long").alias(key)).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {key} long, offset long", "first long", "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    return _windowed(df, time, F.window(time, width), keys, measures, late)


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    return _windowed(df, time, F.window(time, width, step), keys, measures, late)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    return _windowed(df, time, F.session_window(time, gap), keys, measures, late)


def _windowed(df: DataFrame, time: str, window: Column, keys: list[str], measures: list[Column], late: str) -> DataFrame:
    marked = df.withWatermark(time, late) if df.isStreaming else df
    out = marked.groupBy(*keys, window.alias("window")).agg(*measures)
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c not in {*keys, "window"}])


def distinct_within(df: DataFrame, time: str, columns: list[str], late: str) -> DataFrame:
    """First record of each combination of columns within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(columns)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one all executors share."""
    return f"{scratch.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now and returns the rows it wrote.

    With mode complete, each batch replaces the rows of the one before it.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def json_lines(df: DataFrame) -> DataFrame:
    """Records as JSON text, without an index."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def describe(df: DataFrame) -> str:
    """Definition of a record type: names and types."""
    return json.dumps([{"name": n, "type": t} for n, t in df.dtypes])


def observed(df: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """df that reports counters (such as read, filtered, dropped) with each batch to listeners, at no further pass."""
    return df.observe(name, *[v.alias(k) for k, v in counters.items()])


def batched(df: DataFrame, keys: list[str], name: str = "records") -> DataFrame:
    """Records of a key as one container, the inverse of unpack."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias(name))


def deliver(stream: DataFrame, callbacks: dict[str, object], kind: str) -> object:
    """Starts a query that hands the rows of each type in a batch to the callback of that type."""

    def run(part: DataFrame, number: int) -> None:
        kept = part.persist()
        for k, fn in callbacks.items():
            fn(kept.where(F.col(kind) == k), number)
        kept.unpersist()

    return stream.writeStream.option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/log").trigger(availableNow=True).foreachBatch(run).start()
