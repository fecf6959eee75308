"""Proportional stratified interleaving of rows into shards (DataFrame functions only).

Within each source, rows are ranked in a seeded shuffle; the fractional rank
(rank - 1/2) / rows spreads every source evenly over [0, 1).  Sorted by that value
and cut into equal runs, each shard gets every source's share up to one row.

Both rankings are distributed: rows are counted by (source, slice of the shuffle key)
or by slice of the fractional rank, the counts are summed up in two steps (runs of
slices, slices of a run), and rows are numbered inside one slice only.  The number of slices follows the number of rows, so a slice
holds about ``SLICE`` rows, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICE = 4096


def _numbered(rows: DataFrame, keys: list[str], slice_: Column, order: list[str | Column], rank: str) -> DataFrame:
    """Add the 0-based rank of each row in ``order`` per ``keys``; slices are ordered like the rows."""
    cut = rows.withColumn("__slice", slice_)
    sizes = cut.groupBy(*keys, "__slice").agg(F.count("*").alias("__n")).withColumn("__run", F.floor(F.col("__slice") / SLICE))
    runs = sizes.groupBy(*keys, "__run").agg(F.sum("__n").alias("__sum"))
    upto = lambda *of: W.partitionBy(*of).orderBy("__run" if "__run" not in of else "__slice").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "__run", F.coalesce(F.sum("__sum").over(upto(*keys)), F.lit(0)).alias("__first"))  # rows / SLICE ** 2
    here = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(upto(*keys, "__run")), F.lit(0)))
    same = [here[k].eqNullSafe(runs[k]) for k in [*keys, "__run"]]
    base = here.join(runs, same).select(*[here[c] for c in [*keys, "__slice"]], (here["__base"] + runs["__first"]).alias("__base"))
    inner = W.partitionBy(*keys, "__slice").orderBy(*order)
    placed = cut.withColumn("__in", F.row_number().over(inner) - 1)
    on = [placed[k].eqNullSafe(base[k]) for k in [*keys, "__slice"]]
    at = (base["__base"] + placed["__in"]).alias(rank)
    return placed.join(base, on).select(*[placed[c] for c in rows.columns], at)


def interleave(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", stratum: str = "source", seed: str = "7") -> DataFrame:
    """Deal all rows into ``shards`` shards whose row counts differ by one at most.

    Returns the columns of ``docs`` but the text, with ``size`` (UTF-8 bytes of the text
    plus one), ``text_crc32``, ``law`` ('rows'), ``shard`` and ``slot`` (place in the
    shard's order, gapless from 0); input columns of these names are replaced.

    A null text has size 1 and the checksum of no bytes.  A null source is a source of
    its own; a null key is shuffled as an empty one.  Rows with equal key and text are
    interchangeable and take neighbouring places.  An empty table gives no rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot"]
    keep = [c for c in docs.columns if c != text and c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    size, crc = F.octet_length(body).cast("long") + 1, F.crc32(body)
    # The text has a part in it, so that rows without a key, or with one that repeats, are spread too.
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), crc.cast("string"), F.lit(":"), size.cast("string")))
    rows = docs.select(
        *keep,
        size.alias("size"),
        crc.alias("text_crc32"),
        shuffled.alias("__mix"),
        F.col(stratum).alias("__of"),
    )
    of = docs.groupBy(F.col(stratum).alias("__of")).agg(F.count("*").alias("__rows"))
    total = docs.agg(F.count("*").alias("__total"))
    counted = rows.crossJoin(F.broadcast(total))  # one row
    slices = F.ceil(F.col("__total") / SLICE)
    part = F.floor(F.conv(F.substring("__mix", 1, 8), 16, 10).cast("double") / float(1 << 32) * slices).cast("long")
    ranked = _numbered(counted, ["__of"], part, ["__mix", "text_crc32", "size"], "__rank")
    sized = ranked.join(of, ranked["__of"].eqNullSafe(of["__of"])).select(*[ranked[c] for c in ranked.columns], of["__rows"])
    even = sized.withColumn("__even", (F.col("__rank") + 0.5) / F.col("__rows"))
    run = F.floor(F.col("__even") * slices).cast("long")
    order = [F.col("__even"), F.col("__of").asc_nulls_first(), F.col("__rank")]
    dealt = _numbered(even, [], run, order, "__at")
    shard = F.expr(f"__at * {shards} div __total")
    first = F.expr(f"(__shard * __total + {shards - 1}) div {shards}")
    placed = dealt.withColumn("__shard", shard)
    return placed.select(
        *keep, "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), (F.col("__at") - first).alias("slot")
    )
