"""Weights of local quadratic fits (Savitzky-Golay, order 2), computed at plan time."""

from __future__ import annotations

import numpy as np


def quadratic_fit_weights(half: int) -> np.ndarray:
    """Rows: level, slope, curvature of the fit at the window centre; columns: taps ``-half..half``."""
    x = np.arange(-half, half + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, 3, increasing=True))
