"""Imports every catalog module once."""

from __future__ import annotations

import importlib

MODULES = ["telemetry", "lifetime", "sweeps", "audits", "daily", "screening", "forecast", "trajectory", "shapes", "dashboards", "sources", "models"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"helioframe.plans.{m}_queries")


load()
