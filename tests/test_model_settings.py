"""Catalog fits use the rounds and trees of ``config``."""

import inspect
from unittest.mock import MagicMock

import pytest

from helioframe import config
from helioframe.operators import models as M, validation as V
from helioframe.plans import models_queries as Q, stages
from helioframe.plans.registry import CATALOG

FITS = ["healthy_twin", "loocv_gate", "damage_increment_model", "trajectory_models", "model_zoo_cv", "feature_ablation", "window_signal_sweep"]
NAMES = [
    "m10_healthy_twin", "m12_loocv_gate_boosted", "m15_damage_increment_model", "m16_trajectory_models", "m17_model_zoo_cv", "m18_permutation_importance",
    "m19_split_gain_importance", "m22_feature_ablation", "m24_window_signal_sweep", "f04_roll_forward_batch", "f12_trajectory_roll_forward",
]


@pytest.mark.parametrize("name", NAMES)
def test_queries_pass_no_rounds_or_trees(monkeypatch, name):
    spies = {f: MagicMock() for f in FITS}
    for f, spy in spies.items():
        monkeypatch.setattr(M, f, spy)
    for f in ("assemble", "permutation_importance", "split_gain_importance"):
        monkeypatch.setattr(M, f, MagicMock())
    monkeypatch.setattr(M, "blind", lambda units, rows, fit, roll, empty=None: fit("train"))
    for module, f in ((Q, "twin_features"), (Q, "settle"), (Q.D, "rul_days"), (Q.D, "current"), (Q.TQ, "state"), (Q.FQ, "units"), (Q.T, "trajectory_units")):
        monkeypatch.setattr(module, f, MagicMock())
    monkeypatch.setattr(Q.F, "lit", MagicMock())
    monkeypatch.setattr(stages, "settle", MagicMock())
    CATALOG[name].run(MagicMock(), "")
    calls = [c for spy in spies.values() for c in spy.call_args_list]
    assert calls
    for c in calls:
        assert not {"rounds", "trees"} & set(c.kwargs) and not any(isinstance(a, int) for a in c.args)


def test_defaults_are_those_of_config(spark):
    for f in (*FITS, "damage_boost", "zoo", "booster", "forest", "oof_residuals", "threshold"):
        p = inspect.signature(getattr(M, f)).parameters
        assert all(p[x].default is None for x in ("rounds", "trees") if x in p), f
    for f in (V.out_of_fold, V.forests, V.boosters):
        p = inspect.signature(f).parameters
        assert all(p[x].default is None for x in ("rounds", "trees") if x in p), f
    z = M.zoo("y")
    assert z["booster"].getMaxIter() == config.DAMAGE_PARAMS["maxIter"] and z["forest"].getNumTrees() == config.FOREST_PARAMS["numTrees"]
    assert [M.booster("y", M.TWIN[m]).getMaxIter() for m in ("PCE", "pFF")] == [150, 100]
