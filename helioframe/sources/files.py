"""File sources and sinks of the analysis."""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Sequence
from dataclasses import fields
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.config import Coefficients
from helioframe.functions.expr import absolute_humidity

log = logging.getLogger(__name__)

# Raw columns per kind, and those that must not be NULL.
RAW_COLUMNS = {
    "mpp": ["Timestamp", "Voltage_V", "Current_A", "Power_W"],
    "jv": ["Timestamp", "Voltage_V", "Current_A", "ScanDirection"],
    "meteo": ["Timestamp", "POA_Irradiance_W_m2", "ModuleTemp_C", "AmbientTemp_C", "RelativeHumidity_pct"],
}
REQUIRED = {
    "mpp": ["Timestamp", "Voltage_V", "Current_A", "Power_W"],
    "jv": ["Timestamp", "Voltage_V", "Current_A", "ScanDirection"],
    "meteo": ["Timestamp", "POA_Irradiance_W_m2", "ModuleTemp_C"],
}


def _layouts(raw: DataFrame, mark: str) -> dict[str, list[str]]:
    """Files by header line.  The header of a file is its first line with a field named ``mark``."""
    path, at = F.col("_metadata.file_path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    named = raw.select(path.alias("path"), at.alias("at"), "value").where(F.col("value").rlike(rf'(^|,)\s*"?{mark}"?\s*(,|$)'))
    plain = lambda p: re.sub(r"^(\w+):/+(?=[^/])", r"\1:/", unquote(p))  # noqa: E731  file:///x and file:/x are one
    found: dict[str, list[str]] = {}
    for r in named.groupBy("path").agg(F.min_by("value", "at").alias("header")).toLocalIterator():  # one row a file
        found.setdefault(r["header"].lstrip("\ufeff").strip(), []).append(plain(r["path"]))
    missing = set(map(plain, raw.inputFiles())) - {p for paths in found.values() for p in paths}
    if missing:
        raise ValueError(f"no header with {mark} in {sorted(missing)[:5]}")
    return found


def device_csv_scan(
    spark: SparkSession, root: str, kind: str, glob: str | None = None, device_regex: str | None = None
) -> DataFrame:
    """All ``<device>/<device>_<kind>.csv`` files as one table with the device name.

    Files may differ in the order of their columns, in optional and in further ones:
    files of one header are read together, by that header, and columns go by name.  A
    file without the required columns is an error.  A kind without any file gives an
    empty table and a warning.  Other folders are described by ``glob`` and
    ``device_regex``.
    """
    names = RAW_COLUMNS[kind]
    pattern = f"{root.rstrip('/')}/{glob or f'*/*_{kind}.csv'}"
    device = F.regexp_extract(F.col("_metadata.file_path"), device_regex or rf"([^/]+)_{kind}\.csv$", 1).alias("cell_name")
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in ["cell_name", *names]))
    try:
        raw = spark.read.text(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("no %s files below %s", kind, root)
        return out
    for header, paths in sorted(_layouts(raw, names[0]).items()):
        fields = [f.strip() for f in next(csv.reader([header]))]
        lacking = [c for c in REQUIRED[kind] if c not in fields]
        if lacking:
            raise ValueError(f"{lacking} missing in {sorted(paths)[:5]}")
        schema = T.StructType([T.StructField(f if fields.index(f) == i else f"{f}_{i}", T.StringType()) for i, f in enumerate(fields)])
        part = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
        cols = [F.col(c) if c in fields else F.lit(None).cast("string").alias(c) for c in names]
        out = out.unionByName(part.select(device, *cols))
    return out


def parse_and_require(df: DataFrame, required: Sequence[str], floats: Sequence[str]) -> DataFrame:
    """Bad timestamps and numbers become NULL; rows without a required value are dropped."""
    out = df.withColumn("Timestamp", F.try_to_timestamp(F.col("Timestamp").cast("string")))
    for c in floats:
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.dropna(subset=list(required))


def ingest(spark: SparkSession, root: str, kind: str) -> DataFrame:
    raw = device_csv_scan(spark, root, kind)
    floats = [c for c in RAW_COLUMNS[kind] if c not in ("Timestamp", "ScanDirection")]
    out = parse_and_require(raw, REQUIRED[kind], floats)
    if kind == "meteo":
        out = out.withColumn("AbsoluteHumidity_g_m3", absolute_humidity("AmbientTemp_C", "RelativeHumidity_pct"))
    return out


def time_sorted_sink(df: DataFrame, path: str, files_per_day: int = 1) -> None:
    """Parquet per device and day, each file ordered by time.

    A device is split by day (and further by ``files_per_day``), so that no
    single task writes a whole device.
    """
    us = F.unix_micros("Timestamp")
    part = F.floor(F.pmod(us, F.lit(86_400_000_000)) * files_per_day / F.lit(86_400_000_000))
    (
        df.withColumn("day", F.to_date("Timestamp"))
        .withColumn("part", part)
        .repartition("cell_name", "day", "part")
        .sortWithinPartitions("cell_name", "day", "Timestamp")
        .drop("part")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy("cell_name", "day")
        .parquet(path)
    )


def pruned_scan(spark: SparkSession, path: str, columns: Sequence[str], predicate: str = "is_curve_valid = 1") -> DataFrame:
    """Column list and predicate; Catalyst pushes both into the Parquet reader."""
    return spark.read.parquet(path).where(predicate).select(*columns)


def valid_counts(curves: DataFrame) -> DataFrame:
    """Valid curves per device (the curve table has one row per curve)."""
    return curves.where(F.col("is_curve_valid") == 1).groupBy("cell_name").agg(F.countDistinct("curve").alias("n_valid"))


def valid_counts_json(curves: DataFrame, path: str) -> None:
    valid_counts(curves).coalesce(1).write.mode("overwrite").json(path)  # one row per device


def report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


HOURLY = (
    "hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, relative_humidity_2m: ARRAY<DOUBLE>, "
    "shortwave_radiation: ARRAY<DOUBLE>>"
)


def weather_hourly_explode(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Weather payloads with parallel hourly arrays to one row per hour."""
    h = payloads.withColumn("w", F.from_json(column, HOURLY)["hourly"])
    zipped = F.arrays_zip("w.time", "w.temperature_2m", "w.relative_humidity_2m", "w.shortwave_radiation")
    keep = [c for c in payloads.columns if c != column]
    return h.select(*keep, F.explode(zipped).alias("r")).select(
        *keep,
        F.try_to_timestamp("r.time").alias("time"),
        F.col("r.temperature_2m").alias("temperature_2m"),
        F.col("r.relative_humidity_2m").alias("relative_humidity_2m"),
        F.col("r.shortwave_radiation").alias("shortwave_radiation"),
    )


def coefficients_from_json(text: DataFrame, column: str = "payload") -> DataFrame:
    """Calibrated coefficients; the defaults apply as a whole if a required one is missing."""
    names = [f.name for f in fields(Coefficients)]
    default = Coefficients()
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    p = text.withColumn("c", F.from_json(column, schema))
    required = [n for n in names if n not in ("k_blend", "t_ref")]
    complete = F.lit(True)
    for n in required:
        complete = complete & F.col(f"c.{n}").isNotNull()
    keep = [c for c in text.columns if c != column]
    return p.select(
        *keep,
        *[F.when(complete, F.coalesce(f"c.{n}", F.lit(getattr(default, n)))).otherwise(F.lit(getattr(default, n))).alias(n) for n in names],
        complete.alias("is_calibrated"),
    )

