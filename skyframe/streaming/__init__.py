"""Structured Streaming: file ingest, stage metrics and the best scene so far."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..session import checkpoint_root
from ..sources.images import validate_files

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, path: str, glob: str = "*", keep: str = "14 days") -> DataFrame:
    """New files, checked, one row per content within the retention period."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", glob).load(path)
    keyed = files.withColumn("content_key", F.substring(F.sha1("content"), 1, 16))
    return validate_files(keyed, keep=["modificationTime", "content_key", "length"]).withWatermark(
        "modificationTime", keep).dropDuplicatesWithinWatermark(["content_key"])


def stage_metrics(trace: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls, errors and latency per tool and tumbling window; batch or stream."""
    return trace.groupBy(F.window("ts", width).alias("w"), "tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "errors", "mean_ms", "max_ms", "p95_ms")


def stage_metrics_stream(trace: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """The same over a stream; rows later than ``lateness`` are dropped, windows emit once closed."""
    return stage_metrics(trace.withWatermark("ts", lateness), width)


def latest_usable_scene(quality: DataFrame, min_usable: float = 0.3, keep_days: int | None = None) -> DataFrame:
    """Best usable scene per area so far: most usable, then most recent, then largest id.

    Over a table one row per area. Over a stream the best scene of an area is its state, and a batch
    gives a row only for areas whose best scene changed. With ``keep_days`` an area without usable scenes for so many
    days of acquisition time is forgotten, and begins anew with its next scene; scenes older than that when they arrive are dropped.
    """
    usable = quality.where(F.col("usable_fraction") >= min_usable).select("aoi", "usable_fraction", "acq_date", "scene_id")
    if not quality.isStreaming:
        return usable.groupBy("aoi").agg(F.max(F.struct("usable_fraction", "acq_date", "scene_id")).alias("best")).select("aoi", "best.*")
    kinds = {f.name: f.dataType for f in usable.schema.fields}
    fields = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items())
    state_fields = ", ".join(f"{name} {kinds[name].simpleString()}" for name in ("usable_fraction", "acq_date", "scene_id"))
    timeout = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.EventTimeTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        best, newest = old, None
        for rows in batches:
            for found in rows[["usable_fraction", "acq_date", "scene_id"]].itertuples(index=False, name=None):
                newest = found[1] if newest is None else max(newest, found[1])
                if best is None or found > tuple(best):
                    best = found
        if keep_days is not None and newest is not None:
            until = int(pd.Timestamp(newest).timestamp() * 1000) + keep_days * 86_400_000
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if best is not None and (old is None or tuple(best) != tuple(old)):
            state.update(tuple(best))
            yield pd.DataFrame([(*key, *best)], columns=["aoi", "usable_fraction", "acq_date", "scene_id"])

    if keep_days is not None:
        seen = usable.withColumn("_seen", F.col("acq_date").cast("timestamp")).withWatermark("_seen", f"{keep_days} days")
        usable = seen
    return usable.groupBy("aoi").applyInPandasWithState(update, fields, state_fields, "update", timeout)


def run_to_table(stream: DataFrame, label: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Process what is available and return the result as a table.

    Append writes exactly-once files. Update writes the rows of each batch beside those of earlier ones, under
    the number of the batch, so a batch that is run again replaces its own rows and a table grows with what changed;
    ``latest`` of it is the present state. Output and progress live in the shared checkpoint folder, or in ``root``, from
    which a later run goes on.
    """
    spark = stream.sparkSession
    root = root or f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/progress").outputMode(mode)
    if mode == "append":
        query: StreamingQuery = writer.format("parquet").option("path", f"{root}/table").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/table")

    def add(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={version}")

    writer.foreachBatch(add).start().awaitTermination()
    written = StructType([*stream.schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(written).parquet(f"{root}/table")
    except AnalysisException as missing:  # the source held nothing
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], written)


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each key in a table of updates."""
    others = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("row")).select(key, "row.*")
