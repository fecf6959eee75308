"""Thresholds of the analysis.  One frozen object, no module-level shadows."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Coefficients:
    """Damage-to-lifetime coefficients (calibrated fixed values)."""

    phi_0: float = 0.0025
    phi_1: float = 0.0025
    phi_2: float = 1.5
    lambda_w: float = 0.5
    mu: float = 0.2
    eps: float = 0.0
    k_blend: float = 0.2
    t_ref: float = 54.0


@dataclass(frozen=True)
class Settings:
    # geometry and daylight
    cell_area_m2: float = 6.4e-5
    cell_area_cm2: float = 0.64
    daylight_min: float = 100.0
    timezone: str = "Europe/Madrid"
    # sweep quality
    snr_min: float = 3.0
    span_ratio_min: float = 0.10
    spike_relative: float = 0.15
    spike_max_points: int = 2
    unphysical_ratio: float = 0.90
    fallback_noise: float = 1e-7
    night_points_min: int = 500
    hour_start: int = 6
    hour_end: int = 22
    voc_min: float = 0.2
    jsc_min: float = 0.5
    # telemetry
    bucket_seconds: int = 600
    merge_tolerance_seconds: int = 1200
    reference_floor: float = 1e-3
    # lifetime
    t80_fraction: float = 0.80
    t80_days: int = 3
    t80_peak_days: int = 3
    t80_min_poa: float = 400.0
    pff_cap: float = 0.7
    # screening
    burn_in_days: float = 14.0
    burn_in_grid: tuple[float, ...] = (5.0, 7.0, 10.0, 14.0, 21.0, 28.0, 35.0)
    alert_quantile: float = 0.98
    floor_quantile: float = 0.25
    residual_floor: float = 0.01
    alert_gate_pct: float = 25.0
    # forecasting
    rolling_window: int = 7
    anchor_day: float = 14.0
    horizon_eval: int = 14
    horizon_sim: int = 30
    damage_limit: float = 0.20
    min_velocity: float = 1e-4
    rul_max_days: float = 3650.0
    coefficients: Coefficients = field(default_factory=Coefficients)


SETTINGS = Settings()

# Exogenous features of the healthy-baseline regressor.
TWIN_FEATURES = [
    "POA_Irradiance_W_m2",
    "ModuleTemp_C",
    "AbsoluteHumidity_g_m3",
    "Delta_Temp_C_per_h",
    "Delta_Hum_g_m3_per_h",
    "Hour_Sin",
    "Hour_Cos",
    "Day_Sin",
    "Day_Cos",
]

# The purely physical subset used by surrogate trees.
PHYSICAL_FEATURES = TWIN_FEATURES[:5]

# Features of the daily damage-increment model.
DAMAGE_FEATURES = [
    "Daily_Irradiance_Dose",
    "Daily_Max_Temp_C",
    "Daily_Median_Humidity",
    "Rolling_Irradiance",
    "Rolling_Thermal_load",
    "Cumulative_Damage_Lag1",
]

# Parameters followed by the trajectory forecast.
TRAJECTORY_PARAMETERS = ["PCE", "FF", "Jsc", "Voc"]

# Coefficient lists of the exhaustive calibration (3^8 = 6561 rows).
COEFFICIENT_GRID = {
    "phi_0": [0.0010, 0.0015, 0.0025],
    "phi_1": [0.0010, 0.0025, 0.0050],
    "phi_2": [1.0, 1.5, 2.0],
    "lambda_w": [0.5, 0.8, 1.0],
    "mu": [0.20, 0.30, 0.50],
    "eps": [0.0, 0.5, 1.0],
    "k_blend": [0.0, 0.1, 0.2],
    "t_ref": [50.0, 54.0, 58.0],
}

# Blend weights tried by the persistence sweep.
PERSISTENCE_GRID = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.0]

# Booster settings of the two healthy-baseline models and the damage model.
TWIN_PCE_PARAMS = {"maxIter": 150, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8}
TWIN_PFF_PARAMS = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 3, "subsamplingRate": 0.8}
DAMAGE_PARAMS = {"maxIter": 200, "stepSize": 0.03, "maxDepth": 3, "subsamplingRate": 0.75}

# Penalties and share of columns of those models.
TWIN_PENALTIES = {"l2": 1.0}
DAMAGE_PENALTIES = {"l2": 10.0, "l1": 0.5, "columns": 0.8}

# Forest settings of the trajectory models.
FOREST_PARAMS = {"numTrees": 200, "maxDepth": 4, "minInstancesPerNode": 5}

SEED = 42
