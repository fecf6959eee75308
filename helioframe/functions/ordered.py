"""Running sums, lags and carried values over very long device histories.

A window partitioned by device alone puts a whole device into one task.  The
functions here cut each device into time chunks, run the window inside
``(device, chunk)``, and pass a one-row summary per chunk to the next chunk.
Only the summary table (devices x chunks) is windowed per device.  The rows
themselves are shuffled once: the carry is joined on the same keys the window
already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.functions.stages import settle

CHUNK = "__chunk"


def time_chunk(ts: str | Column, seconds: int = 3600) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(ts)
    return F.floor(us / F.lit(seconds * 1_000_000.0)).cast("long")


SUB = 1 << 20


def split_hot_chunks(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, max_rows: int, name: str = "chunk"
) -> DataFrame:
    """Add a time chunk, cutting chunks with more than ``max_rows`` rows into finer ones.

    One narrow counting pass finds the hot (device, chunk) pairs; they are at most
    rows / max_rows, and usually none, in which case nothing is joined.  The chunk
    number never decreases with time.
    """
    us, width = F.unix_micros(ts), seconds * 1_000_000
    base = F.floor(us / F.lit(float(width))).cast("long")
    sizes = df.groupBy(*keys, base.alias("__base")).agg(F.count("*").alias("__n")).where(F.col("__n") > max_rows)
    hot = settle(sizes.select(*keys, "__base", F.ceil(4.0 * F.col("__n") / max_rows).alias("__parts")))
    if hot.isEmpty():
        return df.withColumn(name, base * SUB)
    sub = F.least(F.lit(SUB - 1), F.floor(F.pmod(us, F.lit(width)) * (F.col("__parts") / F.lit(float(width)))))
    j = df.withColumn("__base", base).join(hot, [*keys, "__base"], "left")
    return j.withColumn(name, F.col("__base") * SUB + F.coalesce(sub, F.lit(0))).select(*df.columns, name)


def value_chunk(c: str | Column, width: float) -> Column:
    """Chunk of a numeric ordering column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(width))).cast("long")


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, name: str = CHUNK) -> DataFrame:
    """Store ``df`` with the chunk of each row: ranges of ``(keys, order)`` with bounds from a sample.

    Chunks hold about equally many rows whatever the values are (outliers, dense spots);
    only rows equal in ``keys`` and ``order`` must share one.  Chunks never decrease along
    ``order`` within ``keys``.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    store: bool = False,
) -> DataFrame:
    """Add running values in ``order`` per ``keys``.

    ``sums`` and ``maxes`` are inclusive running aggregates (NULL inputs are
    skipped), ``lasts`` the latest non-null value up to and including the row,
    ``lags`` the value of the row before.  ``chunk`` must not decrease along
    ``order``; given as a column name it is kept, so that a following scan with
    the same chunk needs no further shuffle.  Rows and chunk summaries both read ``df``;
    with ``store`` it is written once with its inputs and both read that table, so that
    nested scans compute each level once instead of twice.
    """
    sums, lasts, lags, maxes = sums or {}, lasts or {}, lags or {}, maxes or {}
    ck = chunk if isinstance(chunk, str) else CHUNK
    base = df if isinstance(chunk, str) else df.withColumn(CHUNK, chunk)
    # Evaluate the inputs once so that the window and the summary agree.
    for group in (sums, lasts, lags, maxes):
        for name, e in group.items():
            base = base.withColumn(f"__in_{name}", e)
    if store:
        base = settle(base)
    at = F.struct(*order)
    inner = W.partitionBy(*keys, ck).orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)

    local = base.withColumn("__first", F.row_number().over(inner) == 1) if lags else base
    parts, carries = [], []
    outer = W.partitionBy(*keys).orderBy(ck)
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    for n in sums:
        local = local.withColumn(f"__l_{n}", F.sum(f"__in_{n}").over(upto))
        parts.append(F.sum(f"__in_{n}").alias(f"__p_{n}"))
        carries.append(F.sum(f"__p_{n}").over(before).alias(f"__c_{n}"))
    for n in maxes:
        local = local.withColumn(f"__l_{n}", F.max(f"__in_{n}").over(upto))
        parts.append(F.max(f"__in_{n}").alias(f"__p_{n}"))
        carries.append(F.max(f"__p_{n}").over(before).alias(f"__c_{n}"))
    for n in lasts:
        v = F.col(f"__in_{n}")
        local = local.withColumn(f"__l_{n}", F.last(v, ignorenulls=True).over(upto))
        parts.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"__p_{n}"))
        carries.append(F.last(f"__p_{n}", ignorenulls=True).over(before).alias(f"__c_{n}"))
    for n in lags:
        v = F.col(f"__in_{n}")
        local = local.withColumn(f"__l_{n}", F.lag(v).over(inner))
        parts.append(F.max_by(v, at).alias(f"__p_{n}"))
        carries.append(F.lag(f"__p_{n}").over(outer).alias(f"__c_{n}"))

    summary = base.groupBy(*keys, ck).agg(*parts)
    carry = summary.select(*keys, ck, *carries)
    out = local.join(carry, [*keys, ck])
    for n in sums:
        both_null = F.col(f"__l_{n}").isNull() & F.col(f"__c_{n}").isNull()
        total = F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))
        out = out.withColumn(n, F.when(~both_null, total))
    for n in maxes:
        out = out.withColumn(n, F.greatest(f"__l_{n}", f"__c_{n}"))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(f"__l_{n}", f"__c_{n}"))
    for n in lags:
        out = out.withColumn(n, F.when(F.col("__first"), F.col(f"__c_{n}")).otherwise(F.col(f"__l_{n}")))
    return out.select(*df.columns, *sums, *lasts, *lags, *maxes)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], bins: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups of any size and any values.

    ``percentile`` keeps every distinct value of a group in one task's memory.
    Here equal values are counted first (map-side combined), the counts are ordered in
    ``bins`` ranges of equal size (by default as many as a shuffle has partitions), and
    running counts find the values at the wanted ranks.
    Returns one row per group with the requested columns and ``n``.
    """
    one = not keys
    src = df.where(F.col(value).isNotNull())
    if one:
        keys, src = ["__all"], src.withColumn("__all", F.lit(1))
    counts = src.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    chunks = range_chunks(counts, keys, ["__v"], bins)
    totals = chunks.groupBy(*keys).agg(F.sum("__n").alias("n"))
    ranked = ordered_scan(chunks, keys, ["__v"], CHUNK, sums={"__to": F.col("__n")}).withColumn("__from", F.col("__to") - F.col("__n"))
    hits, picks = F.lit(False), []
    for i, q in enumerate(qs.values()):
        pos = F.lit(q) * (F.col("n") - 1)
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (r >= F.col("__from")) & (r < F.col("__to"))
            hits = hits | hit
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{tag}{i}"))
    got = ranked.join(totals, keys).where(hits).groupBy(*keys, "n").agg(*picks)
    for i, (name, q) in enumerate(qs.items()):
        pos = F.lit(q) * (F.col("n") - 1)
        got = got.withColumn(
            name, F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (pos - F.floor(pos))
        )
    return got.select(*([] if one else keys), *qs, "n")


def near_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """``exact_quantiles`` of a stored table with few groups, which sorts and shuffles only values near the wanted ranks.

    Approximate quantiles a little below and above each wanted one bound the values that can
    be it; these are counted by value, those below only counted.  Should a rank not lie
    within its bounds, all values are ordered.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ask = [min(max(q + d / accuracy, 0.0), 1.0) for q in qs.values() for d in (-2, 2)]
    bounds = src.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", ask, accuracy).alias("__b"))
    bounds = settle(bounds.where("n > 0"))  # one row a group
    met = attach(src, bounds if not keys else F.broadcast(bounds), keys, "inner")
    v, names = F.col("__v"), list(enumerate(qs.items()))
    near = [v.between(F.get("__b", F.lit(2 * i)), F.get("__b", F.lit(2 * i + 1))) for i, _ in names]
    any_near = F.lit(False)
    for x in near:
        any_near = any_near | x
    under = settle(met.groupBy(*keys).agg(*[F.count_if(v < F.get("__b", F.lit(2 * i))).alias(f"__u{i}") for i, _ in names]))
    few = settle(met.where(any_near).groupBy(*keys, "n", "__b", "__v").agg(F.count("*").alias("__c")))
    j = attach(few, under if not keys else F.broadcast(under), keys, "inner")
    at, picks, sure = W.partitionBy(*keys).orderBy("__v"), [], F.lit(True)
    for i, (_, q) in names:
        mine = F.when(near[i], F.col("__c")).otherwise(0)
        j = j.withColumn(f"__t{i}", F.sum(mine).over(at) + F.col(f"__u{i}")).withColumn(f"__f{i}", F.col(f"__t{i}") - mine)
        pos = F.lit(q) * (F.col("n") - 1)
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((r >= F.col(f"__f{i}")) & (r < F.col(f"__t{i}")), v)).alias(f"__{tag}{i}"))
    got = j.groupBy(*keys, "n").agg(*picks)
    for i, (name, q) in names:
        pos = F.lit(q) * (F.col("n") - 1)
        got = got.withColumn(name, F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (pos - F.floor(pos)))
        sure = sure & F.col(f"__lo{i}").isNotNull() & F.col(f"__hi{i}").isNotNull()
    got = settle(got.select(*keys, *qs, "n", sure.alias("__sure")))
    known = bounds.dropna(subset=keys) if keys else bounds
    return got.drop("__sure") if got.where("__sure").count() == known.count() else exact_quantiles(df, keys, value, qs)


def left_out_quantile(df: DataFrame, keys: Sequence[str], group: str, value: str, q: float = 0.5) -> DataFrame:
    """Exact quantile of the values outside each group: ``keys``, ``group``, ``value`` and ``n``, the rows outside.

    Linear in the rows, whatever the number of groups: without a group, the value of rank
    m is that of rank m + c among all rows, where c counts the group's rows that have at
    most m foreign rows before them.  Null groups and values do not take part; a group
    that is alone has no quantile and no row.
    """
    src = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    keys_of, keys = keys, [*keys, "__all"]
    counts = src.withColumn("__all", F.lit(1)).groupBy(*keys, "__v", "__g").agg(F.count("*").alias("__n"))
    chunks = range_chunks(counts, keys, ["__v", "__g"])
    placed = settle(ordered_scan(chunks, keys, ["__v", "__g"], CHUNK, sums={"__to": F.col("__n")}).withColumn("__from", F.col("__to") - F.col("__n")))
    own = range_chunks(placed, [*keys, "__g"], ["__from"])
    own = ordered_scan(own, [*keys, "__g"], ["__from"], CHUNK, sums={"__own": F.col("__n")})
    totals = placed.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    sizes = placed.groupBy(*keys, "__g").agg(F.sum("__n").alias("__size")).join(totals, keys)
    rest = sizes.withColumn("n", F.col("__total") - F.col("__size")).where("n > 0")
    pos = F.lit(q) * (F.col("n") - 1)
    rest = rest.withColumns({"__lo": F.floor(pos), "__hi": F.ceil(pos), "__share": pos - F.floor(pos)})
    foreign = F.col("__from") - (F.col("__own") - F.col("__n"))  # rows of other groups before
    shift = lambda m: F.sum(F.when(foreign <= F.col(m), F.col("__n")).otherwise(0))
    both = own.join(rest, [*keys, "__g"]).groupBy(*keys, "__g", "n", "__lo", "__hi", "__share").agg(shift("__lo").alias("__clo"), shift("__hi").alias("__chi"))
    asks = F.explode(F.array(*[F.struct((F.col(m) + F.col(c)).alias("pos"), F.lit(i).alias("end")) for i, (m, c) in enumerate((("__lo", "__clo"), ("__hi", "__chi")))]))
    asked = both.withColumn("a", asks).select(*keys, F.col("a.pos").alias("__pos"), F.lit(1).alias("__kind"), F.col("a.end").alias("__end"), "__g", "n", "__share", F.lit(None).cast("double").alias("__v"))
    rows = placed.select(*keys, F.col("__from").alias("__pos"), F.lit(0).alias("__kind"), F.lit(None).cast("int").alias("__end"), F.lit(None).cast(src.schema["__g"].dataType).alias("__g"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("__share"), "__v")
    met = range_chunks(rows.unionByName(asked), keys, ["__pos", "__kind"])
    met = ordered_scan(met, keys, ["__pos", "__kind"], CHUNK, lasts={"__at": F.col("__v")}).where("__kind = 1")
    ends = met.groupBy(*keys, "__g", "n", "__share").agg(*[F.max(F.when(F.col("__end") == i, F.col("__at"))).alias(f"__e{i}") for i in (0, 1)])
    return ends.select(*keys_of, F.col("__g").alias(group), (F.col("__e0") + (F.col("__e1") - F.col("__e0")) * F.col("__share")).alias("value"), "n")


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys; without keys ``other`` is a one-row global aggregate."""
    return df.join(other, list(keys), how) if keys else df.crossJoin(F.broadcast(other))
