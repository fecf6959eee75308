"""Fan-out points: write once, read by every consumer."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: tempfile.TemporaryDirectory | None = None
_shipped: set[str] = set()
#: Whether Spark removes the shuffle files of a query when it ends, and how many tables are being written with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict = {"lock": threading.Lock(), "open": 0, "was": None}


def ship_code(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="helioframe-library-"), "helioframe_library.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only for a local master.

    On a cluster the setting is required: executors share no other folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="helioframe-")
    return _local_scratch.name


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that begin here are removed when they end, not when the driver collects its garbage."""
    with _writing["lock"]:
        if not _writing["open"]:
            _writing["was"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing["open"] += 1
    try:
        yield
    finally:
        with _writing["lock"]:
            _writing["open"] -= 1
            if not _writing["open"]:
                spark.conf.unset(CLEANUP) if _writing["was"] is None else spark.conf.set(CLEANUP, _writing["was"])


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and keeps column pruning for the
    readers.  What was shuffled for it is removed at once.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the stored tables (``settle``) that these read; nothing may read them any more."""
    for t in tables:
        for folder in {os.path.dirname(f) for f in t.inputFiles()}:
            if re.fullmatch(r"stage-[0-9a-f]{32}", os.path.basename(folder)):
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """Rebalance narrow rows before a fan-out if the scan has fewer splits than there are cores.

    With ``most``, also if it has fewer than one for each ``most`` rows, so that a task's
    part of what the rows fan out to does not grow with the input.
    """
    need = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        need = max(need, -(-df.count() // most))
    return df.repartition(need) if df.rdd.getNumPartitions() < need else df
