"""Right-closed resampling of a telemetry file stream."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.config import SETTINGS
from helioframe.functions.stages import shared_folder


def streaming_resample(
    stream: DataFrame, columns: Sequence[str], seconds: int = SETTINGS.bucket_seconds, delay: str = "1 hour"
) -> DataFrame:
    """Means per device and bin ``(t - width, t]``, emitted once the watermark passes ``t``.

    Repeated readings of a device at one time are dropped.  Windows are closed
    on the left, so times are shifted by one microsecond; the window end is then
    the right-closed label.
    """
    shifted = F.timestamp_micros(F.unix_micros("Timestamp") - 1)
    s = (
        stream.withColumn("shifted", shifted)
        .withWatermark("shifted", delay)
        .dropDuplicatesWithinWatermark(["cell_name", "Timestamp"])
    )
    return _bins(s, columns, seconds)


def _bins(shifted: DataFrame, columns: Sequence[str], seconds: int) -> DataFrame:
    agg = shifted.groupBy("cell_name", F.window("shifted", f"{seconds} seconds")).agg(*[F.avg(c).alias(c) for c in columns])
    out = agg.select("cell_name", F.col("window.end").alias("bucket"), *columns)
    return out.where(F.coalesce(*columns).isNotNull())


def open_bins(emitted: DataFrame, readings: DataFrame, columns: Sequence[str], seconds: int = SETTINGS.bucket_seconds) -> DataFrame:
    """Bins that a finished stream has not emitted: those after its last one, from the readings at rest.

    A bin is emitted once the watermark has passed its end, so all that end up to the
    last emitted one are complete, and just the readings after it are aggregated.
    """
    last = emitted.agg(F.max("bucket").alias("last"))  # one row
    rest = readings.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("Timestamp") > F.col("last")))
    shifted = F.timestamp_micros(F.unix_micros("Timestamp") - 1)
    return _bins(rest.withColumn("shifted", shifted).dropDuplicates(["cell_name", "Timestamp"]), columns, seconds)


def run_to_parquet(result: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available, then stop; returns the bins written so far."""
    spark = result.sparkSession
    base = path or os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    q = (
        result.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/table")
