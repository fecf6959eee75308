"""Sweep segmentation, quality rules, electrical parameters and normalised shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from helioframe.config import SETTINGS
from helioframe.functions import expr as X
from helioframe.functions.ordered import exact_quantiles, near_quantiles, ordered_scan, time_chunk
from helioframe.functions.smoothing import quadratic_fit_weights
from helioframe.functions.stages import settle, ship_code
from helioframe.operators import sweep_arrays as A

KEY = ["cell_name", "curve"]
TIME = ["Timestamp", "pt"]


def segment_cycles(
    points: DataFrame, order: Sequence[str] = tuple(TIME), chunk_seconds: int | None = None, max_rows: int = 5_000_000
) -> DataFrame:
    """Number the sweeps of each device: a new one at every turn to Reverse.

    The points are shuffled once, into ranges of (device, order) of at most about
    ``max_rows``; each range numbers its own turns and is stored.  Whether its first row
    starts a sweep depends on the direction carried over from the range before, known
    from one summary row a device and range.  The numbers do not depend on the ranges;
    ``chunk_seconds`` is accepted for earlier callers.  Rows without a device or a time
    are counted and dropped.
    """
    spark = points.sparkSession
    ship_code(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // max_rows))
    ranges = points.repartitionByRange(parts, "cell_name", *order).sortWithinPartitions(*order)
    schema = T.StructType([*points.schema.fields, T.StructField("local_no", T.LongType()), T.StructField("row_no", T.LongType()), T.StructField("rev", T.BooleanType())])
    local = settle(ranges.mapInArrow(A.local_numbers("cell_name", "ScanDirection"), schema).withColumn("chunk", F.spark_partition_id()))
    summary = local.groupBy("cell_name", "chunk").agg(
        F.max("local_no").alias("n"),
        F.max(F.when(F.col("row_no") == 0, F.col("rev"))).alias("head"),
        F.max_by("rev", "row_no").alias("tail"),
    )
    return (
        local.where(F.col("cell_name").isNotNull() & F.col("Timestamp").isNotNull())
        .join(_first_numbers(summary), ["cell_name", "chunk"])
        .withColumn("curve", (F.col("offset") + F.col("local_no")).cast("int"))
        .select(*[c for c in points.columns if c != "curve"], "curve")
    )


def _first_numbers(summary: DataFrame) -> DataFrame:
    """Number of the sweep that each device and range begins with, from its turns and first and last directions.

    At most devices plus ranges, stored so that its size is known.
    """
    chunks = W.partitionBy("cell_name").orderBy("chunk")
    carried = F.lag("tail").over(chunks)
    first = carried.isNull() | (F.col("head") & ~carried)
    return settle(
        summary.withColumn("first", first.cast("int"))
        .withColumn(
            "offset",
            F.coalesce(F.sum(F.col("n") + F.col("first")).over(chunks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            + F.col("first"),
        )
        .select("cell_name", "chunk", "offset")
    )


#: Points that one slice of time holds at most, about: a pass shuffles one slice after the other.
SLICE_ROWS = 300_000_000


def _slices(points: DataFrame, n: int, most: int) -> list[Column]:
    """Conditions that cut ``n`` points into slices of time of about ``most``; bounds from a sample, no time counts as the earliest."""
    many = -(-n // most)
    if many <= 1:
        return [F.lit(True)]
    us = F.unix_micros("Timestamp")
    some = points.select(us.alias("us")).sample(min(1.0, 1_000_000 / n), 0)
    found = some.agg(F.percentile_approx("us", [i / many for i in range(1, many)], 1000)).first()[0]  # one bound a slice
    ends = sorted(set(found or []))
    rest = [(us >= lo) & (us < hi) for lo, hi in zip(ends, ends[1:])] + [us >= ends[-1]] if ends else []
    return [us.isNull() | (us < ends[0]), *rest] if ends else [F.lit(True)]


class _Ranges:
    """Sweeps of unnumbered points, of one pass over ranges of (device, order): what the pass stored, with the sweeps' numbers.

    Slices of time are shuffled one after the other, each into ranges of at most about
    ``max_rows`` points, and one pass numbers the sweeps of each range and makes of them what is
    asked for.  Only sweeps at the ends of a range, and those that arrays do not take
    (``sweep_arrays``), are stored as points (``rest``).  ``form`` is stored in place of
    the shape, which is its column ``shape``.
    """

    def __init__(
        self, points: DataFrame, order: Sequence[str], max_rows: int, *, summaries: bool = False, noise: str | None = None,
        shape_points: int = 0, form: Sequence[Column] = (), directions: bool = False,
    ):
        ship_code(points.sparkSession)
        points = points.where(F.col("cell_name").isNotNull())
        seen = points.agg(F.count("*").alias("n"), F.min(F.when(F.col("Timestamp").isNotNull(), F.col("cell_name"))).alias("first")).first()
        self.first, self.points, self.noise = seen["first"], points, noise
        self.cell = points.schema["cell_id"].dataType
        kinds = "kind int, cell_name string, local_no long, "
        kinds += f"sweep struct<{A.STATS}, {A.PARAMETERS}>, " if summaries else ""
        kinds += "directions array<string>, " if directions else ""
        kinds += "step double, " if noise else ""
        way = ", direction: string" if directions else ""
        kinds += (
            f"shape array<double>, point struct<us: long, pt: long, Voltage_V: double, Current_A: double, cell: {self.cell.simpleString()}, way: boolean{way}>, "
            "end struct<n: long, head: boolean, tail: boolean>"
        )
        schema = T.StructType.fromDDL(kinds)
        self.stats = schema["sweep"].dataType.names if summaries else []
        make = A.of_ranges(to_arrow_schema(schema), self.first, shape_points, noise == "per_device")
        got = None
        slices = _slices(points, seen["n"], SLICE_ROWS)
        for i, inside in enumerate(slices):
            part = _in_ranges(points.where(inside), -(-seen["n"] // (max_rows * len(slices))), order, directions).mapInArrow(make, schema)
            if form:
                part = part.withColumn("shape", F.when(F.col("shape").isNotNull(), F.struct(*form)))
            part = settle(part.withColumn("chunk", F.lit(i * 1_000_000) + F.spark_partition_id()))
            got = part if got is None else got.unionByName(part)
        self.got = got
        self.prefix = _first_numbers(got.where(F.col("kind") == A.END).select("cell_name", "chunk", "end.*"))
        self.rest = self._rest(directions)

    def rows(self, kind: int, *columns: str | Column) -> DataFrame:
        curve = (F.col("offset") + F.col("local_no")).cast("int").alias("curve")
        return self.got.where(F.col("kind") == kind).join(self.prefix, ["cell_name", "chunk"]).select("cell_name", curve, *columns)

    def _rest(self, directions: bool) -> DataFrame:
        back = lambda name: F.col(f"point.{name}").cast(self.points.schema[name].dataType).alias(name)
        direction = F.when(F.col("point.way"), "Reverse").when(~F.col("point.way"), "Forward")
        direction = (F.col("point.direction") if directions else direction).alias("ScanDirection")
        return self.rows(
            A.POINT, F.col("point.cell").alias("cell_id"), F.timestamp_micros("point.us").alias("Timestamp"), back("pt"), direction, back("Voltage_V"), back("Current_A")
        )

    def summary(self) -> DataFrame:
        """What ``curve_summary`` makes of numbered points."""
        fields = [f"sweep.{name}" for name in self.stats if name not in ("cell_id", "us_min", "us_max")]
        whole = self.rows(A.SWEEP, F.col("sweep.cell_id").cast(self.cell).alias("cell_id"), *fields, *_times("sweep."))
        return _finish_parameters(whole).unionByName(curve_summary(self.rest))

    def floor(self) -> DataFrame:
        """What ``noise_floor`` makes of numbered points."""
        night = self.rest.where(X.night_flag("Timestamp"))
        steps = self.got.where(F.col("kind") == A.STEP)
        if self.noise == "first_device":
            night = night.where(F.col("cell_name") == F.lit(self.first))
            return _floor(settle(steps.select(F.col("step").alias("d_i")).unionByName(point_gradient(night).select("d_i"))))
        steps = settle(steps.select("cell_name", F.col("step").alias("d_i")).unionByName(point_gradient(night).select("cell_name", "d_i")))
        cells = self.got.where(F.col("kind").isin(A.SWEEP, A.POINT)).select("cell_name").distinct()
        return _device_floors(cells, steps)

    def grid(self, n_points: int) -> DataFrame:
        """What ``sweep_interpolate`` makes of numbered points."""
        at = [F.floor(F.col("at") / n_points).cast("int").alias("branch"), (F.col("at") % n_points).alias("pos"), "j_norm"]
        whole = self.rows(A.SWEEP, F.posexplode("shape").alias("at", "j_norm")).select(*KEY, *at)
        return whole.unionByName(sweep_interpolate(self.rest, n_points))

    def shapes(self, n_points: int, form: Sequence[Column] = ()) -> DataFrame:
        """What ``shape_vectors`` makes of numbered points, or ``form`` of the shapes."""
        whole = self.rows(A.SWEEP, "shape").where(F.col("shape").isNotNull())
        rest = shape_vectors(self.rest, n_points)
        return whole.select(*KEY, "shape.*").unionByName(rest.select(*KEY, *form)) if form else whole.unionByName(rest)

    def directions(self) -> DataFrame:
        """Directions that occur in each sweep, one row each."""
        whole = self.rows(A.SWEEP, F.explode("directions").alias("ScanDirection"))
        return whole.unionByName(self.rest.select(*KEY, "ScanDirection").distinct())


def _in_ranges(points: DataFrame, parts: int, order: Sequence[str], directions: bool) -> DataFrame:
    """Points in sorted ranges of (device, order), ``parts`` or as many as a shuffle has, with what ``sweep_arrays.of_ranges`` reads."""
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    way = ["ScanDirection"] if directions else [(F.col("ScanDirection") == "Reverse").alias("way")]
    p = points.select("cell_name", *order, "cell_id", F.col("Voltage_V").cast("double").alias("Voltage_V"), F.col("Current_A").cast("double").alias("Current_A"), *way)
    p = p.repartitionByRange(parts, "cell_name", *order).sortWithinPartitions(*order)
    if directions:
        way = [(F.col("ScanDirection") == "Reverse").alias("way"), "ScanDirection", F.col("ScanDirection").alias("direction")]
    else:
        way = ["way"]
    number = F.expr("try_cast(cell_id AS long)")
    return p.select(
        "cell_name", F.unix_micros("Timestamp").alias("us"), F.col("pt").cast("long").alias("pt"), "Voltage_V", "Current_A",
        F.col("cell_id").alias("cell"), number.alias("cell_id"), *way, F.coalesce(X.night_flag("Timestamp"), F.lit(False)).alias("is_night"),
    )


#: Points of a range of ``sweeps_of_points`` at most, about.
RANGE_ROWS = 2_000_000


def sweeps_of_points(
    points: DataFrame, shape_points: int = 0, order: Sequence[str] = tuple(TIME), max_rows: int = RANGE_ROWS, noise_mode: str = "first_device"
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Numbered sweeps of unnumbered points, summarised without storing or shuffling the points again.

    Returns what ``curve_summary`` makes of ``segment_cycles``, the ``noise_floor``, and, with
    ``shape_points``, ``shape_vectors``, all from one pass (``_Ranges``).
    """
    r = _Ranges(points, order, max_rows, summaries=True, noise=noise_mode, shape_points=shape_points)
    return r.summary(), r.floor(), r.shapes(shape_points) if shape_points else None


def _numbered(points: DataFrame) -> bool:
    return "curve" in points.columns


def sweep_directions(points: DataFrame) -> DataFrame:
    """Directions that occur in each sweep; points without ``curve`` are numbered in the same pass."""
    if _numbered(points):
        return points.select(*KEY, "ScanDirection").distinct()
    return _Ranges(points, TIME, RANGE_ROWS, directions=True).directions()


def audited_directions(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sweep_directions`` and ``curve_audit`` of unnumbered points from one pass."""
    r = _Ranges(points, TIME, RANGE_ROWS, summaries=True, noise="first_device", directions=True)
    return r.directions(), curve_audit(None, stats=r.summary(), floor=r.floor())


def point_gradient(points: DataFrame) -> DataFrame:
    """Absolute current step from the point before, within the sweep."""
    w = W.partitionBy(*KEY).orderBy(*TIME)
    return points.withColumn("d_i", F.abs(F.col("Current_A") - F.lag("Current_A").over(w)))


def noise_floor(points: DataFrame, mode: str = "first_device") -> DataFrame:
    """Median night-time current step: one row, or one row per device.

    Points without ``curve`` are numbered in the same pass.
    """
    if not _numbered(points):
        return _Ranges(points, TIME, RANGE_ROWS, noise=mode).floor()
    night = points.where(X.night_flag("Timestamp"))
    if mode == "first_device":
        first = points.select("cell_name").distinct().agg(F.min("cell_name").alias("first_cell"))
        night = night.join(F.broadcast(first), F.col("cell_name") == F.col("first_cell")).drop("first_cell")
        return _floor(settle(point_gradient(night).select("d_i")))
    return _device_floors(points.select("cell_name").distinct(), settle(point_gradient(night).select("cell_name", "d_i")))


def _device_floors(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Noise of each of ``cells`` from stored steps, one row per night point."""
    n = cells.join(steps.groupBy("cell_name").agg(F.count("*").alias("n_night")), "cell_name", "left")
    med = near_quantiles(steps, ["cell_name"], "d_i", {"median": 0.5}).drop("n")
    return n.join(med, "cell_name", "left").select("cell_name", _noise())


def _noise() -> Column:
    good = (F.coalesce("n_night", F.lit(0)) >= SETTINGS.night_points_min) & (F.col("median") > 0)
    return F.when(good, F.col("median")).otherwise(SETTINGS.fallback_noise).alias("noise")


def _floor(steps: DataFrame) -> DataFrame:
    """Noise of stored steps, one row per night point with the step ``d_i``, NULL at the first of a sweep."""
    n = steps.agg(F.count("*").alias("n_night"))
    med = near_quantiles(steps, [], "d_i", {"median": 0.5}).drop("n")
    # Two one-row aggregates; the median is missing when no night point exists.
    return n.join(F.broadcast(med), F.lit(True), "left").select(_noise())


def curve_points(points: DataFrame) -> DataFrame:
    """Point flags and sweep-wide spans; one shuffle by sweep."""
    whole = W.partitionBy(*KEY)
    p = point_gradient(points)
    p = p.withColumn("i_span", F.max("Current_A").over(whole) - F.min("Current_A").over(whole))
    p = p.withColumn("is_night", X.night_flag("Timestamp"))
    p = p.withColumn("is_unphysical", X.unphysical_point("Current_A", "Voltage_V"))
    jump = F.col("d_i") / (F.col("i_span") + 1e-12) > SETTINGS.spike_relative
    return p.withColumn("is_spike", F.coalesce(jump, F.lit(False)))


def _stat_aggregates() -> list[Column]:
    power = F.col("Voltage_V") * F.col("Current_A")
    rev = F.max(F.when(F.col("ScanDirection") == "Reverse", power))
    fwd = F.max(F.when(F.col("ScanDirection") != "Reverse", power))
    return [
        F.max("cell_id").alias("cell_id"),
        F.count("*").alias("n_points"),
        (F.max("Voltage_V") - F.min("Voltage_V")).alias("v_span"),
        F.max("i_span").alias("i_span"),
        F.bool_and("is_night").alias("all_night"),
        F.avg(F.col("is_unphysical").cast("double")).alias("neg_ratio"),
        F.count_if("is_spike").alias("spike_count"),
        F.avg(F.col("is_spike").cast("double")).alias("spike_score"),
        # NULL when one direction is missing
        F.when(
            rev.isNotNull() & fwd.isNotNull(), F.abs(rev - fwd) / F.greatest(F.abs(rev), F.lit(1e-12))
        ).alias("hysteresis_index"),
        F.count_if("is_unphysical").alias("n_unphysical"),
        F.min("Timestamp").alias("t_min"),
        F.max("Timestamp").alias("t_max"),
    ]


def _summaries(points: DataFrame, plain) -> DataFrame:
    """Statistics of each sweep and what its parameters need; ``plain`` does those handed back.

    One shuffle by sweep, sorted by a hash of its key.
    """
    spark = points.sparkSession
    ship_code(spark)
    rev = F.coalesce(F.col("ScanDirection") == "Reverse", F.lit(False))
    number = "try_cast(cell_id AS long) AS cell_id"
    cols = [F.xxhash64(*KEY).alias("group"), *KEY, F.unix_micros("Timestamp").alias("us"), F.col("pt").cast("long").alias("pt")]
    p = points.select(
        *cols, F.col("Voltage_V").cast("double").alias("Voltage_V"), F.col("Current_A").cast("double").alias("Current_A"), F.expr(number),
        F.when(F.col("ScanDirection").isNotNull(), rev).alias("rev"), X.night_flag("Timestamp").alias("is_night"),
    )
    p = p.repartition(*KEY).sortWithinPartitions("group")
    kinds = f"cell_name string, curve {points.schema['curve'].dataType.simpleString()}, done boolean, {A.STATS}, {A.PARAMETERS}"
    schema = T.StructType.fromDDL(kinds)
    got = settle(p.mapInArrow(A.summaries(to_arrow_schema(schema)), schema))
    cell_id = F.col("cell_id").cast(points.schema["cell_id"].dataType).alias("cell_id")
    rest = [c for c in got.columns if c not in (*KEY, "done", "cell_id", "us_min", "us_max")]
    done = got.where("done").select(*KEY, cell_id, *rest, *_times())
    odd = settle(got.where("not done").select(*KEY).distinct())
    if odd.isEmpty():
        return done
    same = (points["cell_name"].eqNullSafe(odd["cell_name"])) & (points["curve"] == odd["curve"])
    return done.unionByName(plain(points.join(odd, same, "left_semi")))


def _times(of: str = "") -> list[Column]:
    return [F.timestamp_micros(f"{of}us_{m}").alias(f"t_{m}") for m in ("min", "max")]


def curve_stats(points: DataFrame) -> DataFrame:
    """One row per sweep: spans, spike and hysteresis scores, night and sign shares."""
    return curve_points(points).groupBy(*KEY).agg(*_stat_aggregates())


def curve_scores(
    points: DataFrame | None, noise_mode: str = "first_device", stats: DataFrame | None = None, floor: DataFrame | None = None
) -> DataFrame:
    """Statistics plus span ratio (to the device median) and signal-to-noise ratio.

    ``stats`` and the noise ``floor`` may be passed in; ``points`` are not needed then.
    Points without ``curve`` are numbered and summarised in one pass, and the parameters of
    each sweep come along.
    """
    if stats is None and not _numbered(points):
        r = _Ranges(points, TIME, RANGE_ROWS, summaries=True, noise=noise_mode)
        stats, floor = r.summary(), r.floor() if floor is None else floor
    stats = settle(curve_stats(points)) if stats is None else stats
    med = exact_quantiles(stats, ["cell_name"], "v_span", {"med_span": 0.5}).drop("n")
    floor = noise_floor(points, noise_mode) if floor is None else floor
    s = stats.join(med, "cell_name", "left")
    s = s.join(floor, "cell_name", "left") if "cell_name" in floor.columns else s.crossJoin(F.broadcast(floor))
    base = F.when(F.col("med_span") > 0, F.col("med_span")).otherwise(1.0)
    return (
        s.withColumn("v_span_ratio", F.col("v_span") / base)
        .withColumn("snr_i", F.col("i_span") / (F.col("noise") + 1e-15))
        .drop("med_span", "noise")
    )


RULES = ["rej_night", "rej_unphysical", "rej_vspan_low", "rej_snr_low", "rej_spike"]


def decide(scores: DataFrame, spike_max: Column | None = None) -> DataFrame:
    """Five rejection rules and their joint verdict."""
    k = F.lit(SETTINGS.spike_max_points) if spike_max is None else spike_max
    d = (
        scores.withColumn("rej_night", F.col("all_night"))
        .withColumn("rej_unphysical", F.col("neg_ratio") > SETTINGS.unphysical_ratio)
        .withColumn("rej_vspan_low", F.col("v_span_ratio") < SETTINGS.span_ratio_min)
        .withColumn("rej_snr_low", F.col("snr_i") < SETTINGS.snr_min)
        .withColumn("rej_spike", F.col("spike_count") > k)
    )
    bad = F.col(RULES[0])
    for r in RULES[1:]:
        bad = bad | F.col(r)
    return d.withColumn("is_curve_valid", (~bad).cast("int"))


def curve_audit(
    points: DataFrame | None, noise_mode: str = "first_device", stats: DataFrame | None = None, floor: DataFrame | None = None
) -> DataFrame:
    """Scores and verdict per sweep; ``stats`` and the noise ``floor`` may be passed in (``curve_scores``)."""
    return decide(curve_scores(points, noise_mode, stats, floor))


def counted_points(stats: DataFrame) -> DataFrame:
    """Points of each sweep by whether they are unphysical, as counts: ``is_unphysical`` and ``n``."""
    bad, n = F.col("n_unphysical"), F.col("n_points")
    kinds = F.array(*[F.struct(F.lit(k).alias("is_unphysical"), c.cast("long").alias("n")) for k, c in ((True, bad), (False, n - bad))])
    return stats.select(*KEY, F.inline(kinds)).where("n > 0")


def drop_unphysical_points(points: DataFrame, audit: DataFrame) -> DataFrame:
    """Remove unphysical points from otherwise valid sweeps only.

    ``points`` may be ``counted_points``, which say so already.
    """
    told = "is_unphysical" in points.columns
    p = points.join(audit.select(*KEY, "is_curve_valid"), KEY)
    bad = (F.col("is_unphysical") if told else X.unphysical_point("Current_A", "Voltage_V")) & (F.col("is_curve_valid") == 1)
    return p.where(~F.coalesce(bad, F.lit(False)))


def device_offsets(per_curve: DataFrame) -> DataFrame:
    """First global sweep id of each device (one row per device)."""
    counts = per_curve.groupBy("cell_name").agg(F.max("curve").alias("n_curves"))
    earlier = W.orderBy("cell_name").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("cell_name", F.coalesce(F.sum("n_curves").over(earlier), F.lit(0)).alias("first_id"))


def curve_global_id(per_curve: DataFrame) -> DataFrame:
    """0-based id over sorted (device, sweep); sweeps of a device are numbered 1..n."""
    return (
        per_curve.join(device_offsets(per_curve), "cell_name")
        .withColumn("id_curve", F.col("first_id") + F.col("curve") - 1)
        .drop("first_id")
    )


def device_ids(per_curve: DataFrame) -> DataFrame:
    """0-based device index in name order (one row per device)."""
    names = per_curve.select("cell_name").distinct()
    return names.withColumn("device_no", F.dense_rank().over(W.orderBy("cell_name")) - 1)


# -- electrical parameters ----------------------------------------------------


def _by_voltage(points: DataFrame) -> DataFrame:
    """Current density, power and positions within the sweep.

    The sorts by nearness come first, while the rows are still narrow; the
    voltage order comes last and serves every later window.
    """
    near = W.partitionBy(*KEY)
    w = near.orderBy("Voltage_V", *TIME)
    p = points.withColumn("J", X.current_density("Current_A"))
    p = p.withColumn("near_j", F.row_number().over(near.orderBy(F.abs("J"), "Voltage_V", *TIME)))
    p = p.withColumn("near_v", F.row_number().over(near.orderBy(F.abs("Voltage_V"), "Voltage_V", *TIME)))
    p = p.withColumn("P", F.col("Voltage_V") * F.col("J"))
    return p.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy(*KEY)))


def _crossing_columns(p: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("Voltage_V", *TIME)
    return p.withColumn("v1", F.lead("Voltage_V").over(w)).withColumn("j1", F.lead("J").over(w))


def _crossing_aggregates() -> list[Column]:
    v, j, v1, j1, rn = (F.col(c) for c in ("Voltage_V", "J", "v1", "j1", "rn"))
    turn_j = j1.isNotNull() & (F.signum(j) != F.signum(j1))
    turn_v = v1.isNotNull() & (F.signum(v) != F.signum(v1))
    v_at_j0 = v - j * (v1 - v) / F.nullif(j1 - j, F.lit(0.0))
    j_at_v0 = j - v * (j1 - j) / F.nullif(v1 - v, F.lit(0.0))
    return [
        F.max("n").alias("n"),
        F.min_by(v_at_j0, F.when(turn_j & (v > 0.1), rn)).alias("voc_cross"),
        F.min_by(v_at_j0, F.when(turn_j, rn)).alias("compat_cross"),
        F.min_by(j_at_v0, F.when(turn_v, rn)).alias("jsc_cross"),
        F.max(F.when(F.col("near_j") == 1, v)).alias("v_nearest"),
        F.max(F.when(F.col("near_v") == 1, j)).alias("j_nearest"),
        F.avg(F.when(F.col("near_j") <= 5, v)).alias("v_near5"),
        F.avg(F.when(F.col("near_v") <= 5, j)).alias("j_near5"),
        ((F.min("Voltage_V") <= 0) & (F.max("Voltage_V") >= 0)).alias("spans_zero"),
    ]


def _finish_crossings(c: DataFrame) -> DataFrame:
    def guarded(x: Column, near: str) -> Column:
        off = (F.col(near) != 0) & ((F.try_divide(x, F.col(near)) >= 1.5) | (x <= 0))
        return F.when(F.col("n") >= 10, F.when(off, F.col(near)).otherwise(x))

    c = c.withColumn("voc", guarded(F.coalesce("voc_cross", "v_nearest"), "v_near5"))
    c = c.withColumn("jsc", guarded(F.coalesce("jsc_cross", "j_nearest"), "j_near5"))
    compat = F.when(F.col("spans_zero"), F.coalesce("compat_cross", "v_nearest")).otherwise(F.col("j_nearest"))
    c = c.withColumn("jsc_compat", guarded(compat, "j_near5"))
    return c.drop("voc_cross", "compat_cross", "jsc_cross", "v_nearest", "j_nearest", "spans_zero")


def crossings(points: DataFrame) -> DataFrame:
    """Open-circuit voltage and short-circuit current of each sweep.

    Linear interpolation at the first sign change in voltage order, guarded by
    the mean of the five nearest points.  ``jsc_compat`` is the voltage-valued
    variant kept for comparison.
    """
    return _finish_crossings(_crossing_columns(_by_voltage(points)).groupBy(*KEY).agg(*_crossing_aggregates()))


def _smooth_columns(p: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("Voltage_V", *TIME)
    whole = W.partitionBy(*KEY)
    for k in range(-5, 6):
        tap = F.lead("P", k).over(w) if k > 0 else F.lag("P", -k).over(w) if k < 0 else F.col("P")
        p = p.withColumn(f"tap{k + 5}", tap)
    rn, n = F.col("rn"), F.col("n")

    def fit(half: int) -> Column:
        parts = []
        for weights, name in zip(quadratic_fit_weights(half), ("level", "slope", "bend")):
            e = F.lit(0.0)
            for k in range(-half, half + 1):
                e = e + F.lit(float(weights[k + half])) * F.col(f"tap{k + 5}")
            parts.append(e.alias(name))
        return F.struct(*parts)

    p = p.withColumn("half", F.when(n >= 11, 5).otherwise(4)).withColumn("fit", F.when(n >= 11, fit(5)).otherwise(fit(4)))
    p = p.withColumn("head", F.max(F.when(rn == F.col("half") + 1, F.col("fit"))).over(whole))
    p = p.withColumn("tail", F.max(F.when(rn == n - F.col("half"), F.col("fit"))).over(whole))

    def at(f: str, x: Column) -> Column:
        return F.col(f"{f}.level") + F.col(f"{f}.slope") * x + F.col(f"{f}.bend") * x * x

    smooth = (
        F.when(rn <= F.col("half"), at("head", rn - F.col("half") - 1))
        .when(rn > n - F.col("half"), at("tail", rn - n + F.col("half")))
        .otherwise(F.col("fit.level"))
    )
    return p.withColumn("smooth", F.when(n >= 10, smooth))


def _smooth_aggregates() -> list[Column]:
    at = F.when(F.col("smooth").isNotNull(), F.struct("smooth", -F.col("rn")))
    return [F.max_by(F.struct("smooth", "Voltage_V", "J"), at).alias("best")]


def _finish_smooth(m: DataFrame) -> DataFrame:
    ok = (F.col("best.smooth") > 0) & (F.col("best.Voltage_V") > 0) & (F.col("best.J") > 0)
    return (
        m.withColumn("p_mpp", F.col("best.smooth"))
        .withColumn("v_mpp", F.col("best.Voltage_V"))
        .withColumn("j_mpp", F.col("best.J"))
        .withColumn("err_mpp", (~F.coalesce(ok, F.lit(False))).cast("int"))
        .drop("best")
    )


def mpp_smoothed(points: DataFrame) -> DataFrame:
    """Maximum power point of the quadratically smoothed power curve.

    Inside, the fit is centred on each point; the edges evaluate the first and
    the last full fit.  Eleven points per fit (nine for a ten-point sweep).  Points without
    ``curve`` are numbered in the same pass.
    """
    if not _numbered(points):
        return _Ranges(points, TIME, RANGE_ROWS, summaries=True).summary().select(*KEY, "p_mpp", "v_mpp", "j_mpp", "err_mpp")
    return _finish_smooth(_smooth_columns(_by_voltage(points)).groupBy(*KEY).agg(*_smooth_aggregates()))


def fill_factor(v: Column, j: Column, voc: Column, jsc: Column) -> Column:
    raw = F.when((voc > 0) & (jsc > 0), F.try_divide(v * j, voc * jsc))
    return F.when((raw > 0) & (raw < 1), raw)


def _finish_parameters(c: DataFrame) -> DataFrame:
    c = _finish_smooth(_finish_crossings(c))
    c = c.withColumn("ff", fill_factor(F.col("v_mpp"), F.col("j_mpp"), F.col("voc"), F.col("jsc")))
    return (
        c.withColumn("err_voc", F.col("voc").isNull().cast("int"))
        .withColumn("err_jsc", F.col("jsc").isNull().cast("int"))
        .withColumn("err_ff", F.col("ff").isNull().cast("int"))
    )


def electrical_parameters(points: DataFrame) -> DataFrame:
    """All parameters of each sweep from one shuffle by sweep."""
    p = _smooth_columns(_crossing_columns(_by_voltage(points)))
    return _finish_parameters(p.groupBy(*KEY).agg(*_crossing_aggregates(), *_smooth_aggregates()))


def curve_summary(points: DataFrame) -> DataFrame:
    """Quality statistics and electrical parameters together: the points are shuffled once."""

    def plain(p: DataFrame) -> DataFrame:
        p = _smooth_columns(_crossing_columns(_by_voltage(curve_points(p))))
        return p.groupBy(*KEY).agg(*_stat_aggregates(), *_crossing_aggregates(), *_smooth_aggregates())

    return _finish_parameters(_summaries(points, plain))


def physics_gate(audit: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Reject valid sweeps of dead devices: too little voltage or photocurrent.

    ``params`` is not needed when the audit table carries them already.
    """
    has = {"voc", "jsc"} <= set(audit.columns)
    a = audit if has else audit.join(params.select(*KEY, "voc", "jsc"), KEY, "left")
    weak = (F.coalesce("voc", F.lit(0.0)) < SETTINGS.voc_min) | (F.coalesce("jsc", F.lit(0.0)) < SETTINGS.jsc_min)
    a = a.withColumn("rej_dead_cell", (F.col("is_curve_valid") == 1) & weak)
    return a.withColumn("is_curve_valid", F.when(F.col("rej_dead_cell"), 0).otherwise(F.col("is_curve_valid")))


def composite_key_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Mark rows whose keys occur in ``keys`` (a left join on distinct keys)."""
    marks = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


# -- earlier rule set -----------------------------------------------------------


def frozen_points(points: DataFrame, window: int = 15) -> DataFrame:
    """Points at which voltage or current has not moved over the last rows."""
    w = W.partitionBy(*KEY).orderBy(*TIME).rowsBetween(1 - window, 0)
    v = F.max("Voltage_V").over(w) - F.min("Voltage_V").over(w)
    i = F.max("Current_A").over(w) - F.min("Current_A").over(w)
    return points.withColumn("is_frozen", (v <= 1e-4) | (i <= 1e-6))


def direction_symmetry(points: DataFrame, mismatch: float = 0.60) -> DataFrame:
    """Forward/reverse balance in point count and mean current, and low-span rules."""
    rev = F.col("ScanDirection") == "Reverse"
    s = points.groupBy(*KEY).agg(
        F.count_if(~rev).alias("n_fwd"),
        F.count_if(rev).alias("n_rev"),
        F.coalesce(F.avg(F.when(~rev, F.col("Current_A"))), F.lit(0.0)).alias("mean_fwd"),
        F.coalesce(F.avg(F.when(rev, F.col("Current_A"))), F.lit(0.0)).alias("mean_rev"),
    )
    ratio = F.col("n_fwd") / (F.col("n_rev") + 1e-9)
    top = F.greatest("mean_fwd", "mean_rev") + 1e-9
    off = F.abs(F.col("mean_fwd") - F.col("mean_rev")) / top
    return s.withColumn(
        "is_asymmetric", (F.col("n_fwd") == 0) | (F.col("n_rev") == 0) | (ratio < 0.85) | (ratio > 1.15)
    ).withColumn("is_mean_mismatch", off > mismatch)


# -- timing ----------------------------------------------------------------------


def curve_intervals(per_curve: DataFrame) -> DataFrame:
    """Start-to-start interval of consecutive sweeps of a device, in seconds."""
    prev = ordered_scan(
        per_curve, ["cell_name"], ["t_min", "curve"], time_chunk("t_min", 86400), lags={"t_prev": F.col("t_min")}
    )
    return prev.withColumn("interval_s", (F.unix_micros("t_min") - F.unix_micros("t_prev")) / F.lit(1e6))


def curve_timings(per_curve: DataFrame) -> DataFrame:
    """Per device and overall (NULL device): durations, intervals, busiest local day."""
    valid = F.col("is_curve_valid") == 1
    c = curve_intervals(per_curve).withColumn(
        "duration_s", F.when(valid, (F.unix_micros("t_max") - F.unix_micros("t_min")) / F.lit(1e6))
    )
    day = F.to_date(F.from_utc_timestamp("t_min", SETTINGS.timezone))
    c = c.withColumn("local_day", day)
    short = F.when(F.col("interval_s") < 3600, F.col("interval_s"))
    # Day level first: small partial rows, then the roll-up.
    daily = c.groupBy("cell_name", "local_day").agg(
        F.count_if(valid).alias("n_valid"),
        F.sum("duration_s").alias("dur"),
        F.count("duration_s").alias("n_dur"),
        F.sum(short).alias("gap"),
        F.count(short).alias("n_gap"),
    )
    return daily.rollup("cell_name").agg(
        F.sum("n_valid").alias("n_valid"),
        F.try_divide(F.sum("dur"), F.sum("n_dur")).alias("mean_duration_s"),
        F.try_divide(F.sum("gap"), F.sum("n_gap")).alias("mean_interval_s"),
        F.max("n_valid").alias("peak_curves_per_day"),
    )


# -- normalised shapes ------------------------------------------------------------


def split_at_turnaround(points: DataFrame) -> DataFrame:
    """Index of the point farthest from the start voltage; sweeps turning too early or late are unusable."""
    w = W.partitionBy(*KEY).orderBy(*TIME)
    p = points.withColumn("idx", F.row_number().over(w) - 1)
    p = p.withColumn("v0", F.first("Voltage_V").over(w))
    far = F.abs(F.col("Voltage_V") - F.col("v0"))
    s = p.withColumn("far", far).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.max_by("idx", F.struct("far", -F.col("idx"))).alias("idx_turn")
    )
    usable = (F.col("n") >= 10) & (F.col("idx_turn") >= 2) & (F.col("idx_turn") <= F.col("n") - 3)
    return s.withColumn("usable", usable)


def sweep_interpolate(points: DataFrame, n_points: int = 50) -> DataFrame:
    """Normalised sweeps on a common grid: one row per (sweep, branch, grid position).

    Each pair of neighbouring points emits the grid positions that fall between
    them, so no sweep is ever gathered into one record.  Points without ``curve`` are
    numbered in the same pass, which takes whole sweeps as arrays (``sweep_arrays``).
    """
    if not _numbered(points):
        return _Ranges(points, TIME, RANGE_ROWS, shape_points=n_points).grid(n_points)
    w = W.partitionBy(*KEY).orderBy(*TIME)
    whole = W.partitionBy(*KEY)
    p = points.withColumn("idx", F.row_number().over(w) - 1)
    p = p.withColumn("v0", F.first("Voltage_V").over(w))
    p = p.withColumn("far", F.abs(F.col("Voltage_V") - F.col("v0")))
    p = p.withColumn("n", F.count("*").over(whole))
    p = p.withColumn("idx_turn", -F.max(F.struct("far", -F.col("idx"))).over(whole)["col2"])
    for c, s in (("Voltage_V", "v"), ("Current_A", "i")):
        p = p.withColumn(f"{s}_lo", F.min(c).over(whole)).withColumn(f"{s}_hi", F.max(c).over(whole))
    p = p.where(
        (F.col("n") >= 10) & (F.col("idx_turn") >= 2) & (F.col("idx_turn") <= F.col("n") - 3)
        & (F.col("v_hi") > F.col("v_lo")) & (F.col("i_hi") > F.col("i_lo"))
    )
    branches = F.when(F.col("idx") < F.col("idx_turn"), F.array(F.lit(0)))
    branches = branches.when(F.col("idx") > F.col("idx_turn"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    p = p.select(
        *KEY,
        F.explode(branches).alias("branch"),
        ((F.col("Voltage_V") - F.col("v_lo")) / (F.col("v_hi") - F.col("v_lo"))).alias("x"),
        ((F.col("Current_A") - F.col("i_lo")) / (F.col("i_hi") - F.col("i_lo"))).alias("y"),
    )
    u = p.groupBy(*KEY, "branch", "x").agg(F.avg("y").alias("y"))
    line = W.partitionBy(*KEY, "branch").orderBy("x")
    u = u.withColumn("x1", F.lead("x").over(line)).withColumn("y1", F.lead("y").over(line))
    u = u.withColumn("is_first", F.row_number().over(line) == 1)
    last = n_points - 1
    start = F.when(F.col("is_first"), 0).otherwise(F.ceil(F.col("x") * last)).cast("int")
    stop = F.when(F.col("x1").isNull(), last).otherwise(F.ceil(F.col("x1") * last) - 1).cast("int")
    u = u.withColumn("g0", start).withColumn("g1", stop).where(F.col("g0") <= F.col("g1"))
    u = u.withColumn("pos", F.explode(F.sequence("g0", "g1")))
    g = F.col("pos") / F.lit(float(last))
    slope = (F.col("y1") - F.col("y")) / F.nullif(F.col("x1") - F.col("x"), F.lit(0.0))
    y = F.when(F.col("x1").isNull() | (g < F.col("x")), F.col("y")).otherwise(F.col("y") + slope * (g - F.col("x")))
    return u.select(*KEY, "branch", "pos", y.alias("j_norm"))


def shape_vectors(points: DataFrame, n_points: int = 50, form: Sequence[Column] = ()) -> DataFrame:
    """Hundred-element shape per sweep: reverse branch, then forward branch.

    With ``form``, these columns of the column ``shape`` in its place.  Points without ``curve``
    are numbered in the same pass, and then the form alone is stored.
    """
    if not _numbered(points):
        return _Ranges(points, TIME, RANGE_ROWS, shape_points=n_points, form=form).shapes(n_points, form)
    g = sweep_interpolate(points, n_points)
    at = F.col("branch") * n_points + F.col("pos")
    packed = g.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("j_norm")))).alias("a"))
    shapes = packed.select(*KEY, F.transform("a", lambda s: s["j_norm"]).alias("shape"))
    return shapes.select(*KEY, *form) if form else shapes
