"""As-of joins without a join: one union, one chunked scan.

Both inputs are stacked, ordered by time inside ``(key, chunk)``, and the last
seen right row is carried forward.  Chunk summaries pass the carried row on, so
a device that holds most of the rows is spread over its time chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.ordered import ordered_scan


def _scan(left: DataFrame, right: DataFrame, keys: Sequence[str], sign: int, chunk_seconds: int) -> DataFrame:
    """Left rows with the nearest right row at or before them on the signed clock."""
    stacked = left.select(
        *keys, "at_us", F.lit(1).alias("side"), F.lit(None).cast("long").alias("tie"),
        F.col("left_row"), F.lit(None).cast(right.schema["right_row"].dataType).alias("right_row"),
    ).unionByName(
        right.select(
            *keys, "at_us", F.lit(0).alias("side"), (F.col("tie") * sign).alias("tie"),
            F.lit(None).cast(left.schema["left_row"].dataType).alias("left_row"), "right_row",
        )
    )
    stacked = stacked.withColumn("at_us", F.col("at_us") * sign)
    chunk = F.floor(F.col("at_us") / F.lit(chunk_seconds * 1_000_000.0)).cast("long")
    scanned = ordered_scan(
        stacked, keys, ["at_us", "side", "tie"], chunk, lasts={"matched": F.col("right_row")}, store=True
    )
    return scanned.where(F.col("side") == 1)


def _pack(left, right, keys, left_ts, right_ts, right_columns, tie):
    lrow = F.struct(*[F.col(c) for c in left.columns]).alias("left_row")
    l = left.select(*keys, F.unix_micros(left_ts).alias("at_us"), lrow)
    rrow = F.struct(F.unix_micros(right_ts).alias("at_us"), *[F.col(c) for c in right_columns]).alias("right_row")
    r = right.select(*keys, F.unix_micros(right_ts).alias("at_us"), F.col(tie).cast("long").alias("tie"), rrow)
    return l, r


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_columns: Sequence[str],
    tie: str,
    tolerance_seconds: int,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Each left row with the most recent right row at or before it (inclusive tolerance).

    Rows at equal times are ordered by ``tie``; the last one wins.
    """
    l, r = _pack(left, right, keys, left_ts, right_ts, right_columns, tie)
    s = _scan(l, r, keys, 1, chunk_seconds)
    near = F.col("at_us") - F.col("matched.at_us") <= tolerance_seconds * 1_000_000
    return s.select("left_row.*", *[F.when(near, F.col(f"matched.{c}")).alias(c) for c in right_columns])


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_columns: Sequence[str],
    tie: str,
    tolerance_seconds: int,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Each left row with the closest right row on either side; ties go backward."""
    l, r = _pack(left, right, keys, left_ts, right_ts, right_columns, tie)
    back = _scan(l, r, keys, 1, chunk_seconds)
    # Carry the backward match along and scan once more on the reversed clock.
    l2 = back.select(*keys, "at_us", F.struct("left_row", F.col("matched").alias("back")).alias("left_row"))
    fwd = _scan(l2, r, keys, -1, chunk_seconds)
    now, b, f = -F.col("at_us"), F.col("left_row.back"), F.col("matched")
    gap_b, gap_f = now - b["at_us"], f["at_us"] - now
    best = F.when(gap_f.isNull() | (gap_b <= gap_f), b).otherwise(f)
    picked = fwd.select(
        F.col("left_row.left_row").alias("lr"), best.alias("best"), F.abs(best["at_us"] - now).alias("gap")
    )
    ok = F.col("gap") <= tolerance_seconds * 1_000_000
    return picked.select("lr.*", *[F.when(ok, F.col(f"best.{c}")).alias(c) for c in right_columns])
