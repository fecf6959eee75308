"""Session helpers shared by the operators: shipping code, stored tables, row sources."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.stages import settle

__all__ = ["settle", "drop_stored", "ship", "table", "word_list", "partitions", "DOCUMENT_COLUMNS"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A word is a run of characters other than the six ASCII white space characters.
WORD_GAP = "[\\x20\\x09-\\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="helioframe-code-"), "helioframe_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``settle`` that nothing reads any more."""
    for t in tables:
        for folder in {os.path.dirname(f) for f in t.inputFiles()}:
            if not re.fullmatch(r"stage-[0-9a-f]{32}", os.path.basename(folder)):
                raise ValueError(f"not a stored table: {folder}")
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_list(text: Column) -> Column:
    """Words of a text in order; none for a null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")
