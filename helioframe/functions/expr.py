"""Reusable column expressions; everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.config import SETTINGS, Coefficients

DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absolute_humidity(temp_c: Column | str, rh_pct: Column | str) -> Column:
    """Grams of water per cubic metre from temperature and relative humidity."""
    t, rh = col(temp_c), col(rh_pct)
    saturation = F.lit(6.112) * F.exp(F.lit(17.67) * t / (t + 243.5))
    return F.lit(216.68) * (saturation * rh / 100.0) / (t + 273.15)


def pce_from_power(power: Column | str, poa: Column | str, area: float = SETTINGS.cell_area_m2) -> Column:
    """Efficiency in percent; NULL unless the irradiance exceeds the daylight limit."""
    p, g = col(power), col(poa)
    raw = p / F.nullif(g * F.lit(area), F.lit(0.0)) * 100.0
    clipped = F.when(raw.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))
    return F.when(g > SETTINGS.daylight_min, clipped)


def current_density(current: Column | str) -> Column:
    return col(current) * 1000.0 / F.lit(SETTINGS.cell_area_cm2)


def relative_to_initial(x: Column | str, x0: Column | str) -> Column:
    return col(x) / F.greatest(col(x0), F.lit(SETTINGS.reference_floor))


def local_hour(ts: Column | str, tz: str = SETTINGS.timezone) -> Column:
    return F.hour(F.from_utc_timestamp(col(ts), tz))


def night_flag(ts: Column | str) -> Column:
    return ~local_hour(ts).between(SETTINGS.hour_start, SETTINGS.hour_end)


def unphysical_point(current: Column | str, voltage: Column | str) -> Column:
    return (col(current) < 0) & (col(voltage) < 0.5)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_US))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clip and keep NULL (``least``/``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def cyclic_time(ts: Column | str) -> dict[str, Column]:
    t = col(ts)
    hour = (F.hour(t) + F.minute(t) / 60.0) / 24.0
    day = F.dayofyear(t) / 365.25
    turn = 2.0 * 3.141592653589793
    return {
        "Hour_Sin": F.sin(hour * turn),
        "Hour_Cos": F.cos(hour * turn),
        "Day_Sin": F.sin(day * turn),
        "Day_Cos": F.cos(day * turn),
    }


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the pairs that both have: NULL below two pairs, NaN if one of them never varies.

    ``corr`` divides by zero there, which ANSI mode makes an error.
    """
    x, y = col(x), col(y)
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    r = F.coalesce(F.try_divide(F.regr_sxy(y, x), spread), F.lit(float("nan")))
    return F.when(F.regr_count(y, x) > 1, r)


def right_closed_bucket(ts: Column | str, seconds: int) -> Column:
    """Label of the bin ``(label - width, label]`` that holds the timestamp."""
    width = seconds * 1_000_000
    us = F.unix_micros(col(ts))
    return F.timestamp_micros(us + F.pmod(-us, F.lit(width)))


def left_closed_bucket(ts: Column | str, seconds: int) -> Column:
    width = seconds * 1_000_000
    us = F.unix_micros(col(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def rul_from_damage(d0: Column, d_end: Column, n: Column, c: dict[str, Column] | None = None) -> Column:
    """Days to the damage limit from start damage, projected damage and horizon length."""
    c = c or {k: F.lit(v) for k, v in vars(Coefficients()).items()}
    limit, slowest = F.lit(SETTINGS.damage_limit), F.lit(SETTINGS.min_velocity)
    speed = F.greatest(slowest, (d_end - d0) / n)
    ratio = F.greatest(F.lit(0.0), d0) / limit
    floor = c["phi_0"] + c["phi_1"] * F.exp(ratio * c["phi_2"])
    weight = F.pow(F.least(F.lit(1.0), ratio), c["lambda_w"])
    blended = F.greatest(slowest, (1.0 - weight) * speed + weight * F.greatest(speed, floor))
    days = F.least((limit - d0) / blended, F.lit(SETTINGS.rul_max_days))
    return F.when(d0 >= limit, F.lit(0.0)).when(d_end.isNotNull(), days)


def clock_blend(r: Column, day: Column, k: Column, t_ref: Column) -> Column:
    """Weighted mean of an estimate and the plain countdown to ``t_ref``."""
    return F.when(k > 0, (1.0 - k) * r + k * F.greatest(F.lit(0.0), t_ref - day)).otherwise(r)


def diagnostic_status(burn_in: float = SETTINGS.burn_in_days, gate: float = SETTINGS.alert_gate_pct) -> Column:
    """Status text from survival days and alert percentages of one device."""
    t_pce = F.coalesce(F.col("survival_days_pce") <= burn_in, F.lit(False))
    t_pff = F.coalesce(F.col("survival_days_pff") <= burn_in, F.lit(False))
    m_pce = F.coalesce(F.col("alert_pce_pct") > gate, F.lit(False))
    m_pff = F.coalesce(F.col("alert_pff_pct") > gate, F.lit(False))
    m_any = F.coalesce(F.col("alert_freq_pct") > gate, F.lit(False))
    t80 = (
        F.when(t_pce & t_pff, "T80(Dual)").when(t_pce, "T80(PCE)").when(t_pff, "T80(pFF)")
    )
    ml = (
        F.when(m_pce & m_pff, "ML(Dual)").when(m_pce, "ML(PCE)").when(m_pff, "ML(pFF)").when(m_any, "ML(Combined)")
    )
    text = F.concat_ws(" + ", t80, ml)
    return F.when(~F.col("extrinsic_failure"), "Healthy").when(text == "", "Unknown").otherwise(text)


def physical_truth(night: Column, voc: Column, jsc: Column) -> Column:
    """Independent physical verdict of a curve, used to audit the filter."""
    return (
        F.when(night, "reject_night")
        .when((voc > 0.5) & (jsc > 2.0), "accept")
        .when((voc < 0.4) | (jsc < 1.0), "reject_bad")
        .otherwise("gray")
    )
