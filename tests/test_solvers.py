"""Fits that rounding would keep from ending."""

from __future__ import annotations

import numpy as np
import pytest

from signalframe.operators import solvers


def smooth_series(seed: int, n: int = 900) -> tuple[np.ndarray, np.ndarray]:
    """Lags, means and returns of values that hardly differ, as sums over very many rows do: large, nearly dependent columns beside tiny ones."""
    rng = np.random.default_rng(seed)
    value = 1500.0 + rng.normal(0, 4.0, n + 30)
    lags = np.column_stack([value[30 - k : n + 30 - k] for k in (1, 2, 3, 5, 21)])
    means = np.column_stack([np.convolve(value, np.ones(k) / k, "valid")[-n:] for k in (5, 21)])
    returns = np.column_stack([value[30:] / value[30 - k : n + 30 - k] - 1 for k in (1, 5, 21)])
    up = (np.roll(value, -7)[30:] > value[30:]).astype(float)
    return np.column_stack([returns, lags, means]), up


@pytest.mark.parametrize("seed", range(4))
def test_a_fit_ends_where_rounding_hides_the_gain(monkeypatch, seed):
    x, y = smooth_series(seed)
    steps, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: steps.append(b @ solve(a, b)) or solve(a, b))
    model, most = solvers.Logistic(scale=False), 0
    for end in range(504, 544):
        steps.clear()
        model.fit(x[:end], y[:end])
        most = max(most, len(steps))
        assert steps[-1] < 1e-10  # what the last step promised, of a value of some 300
    assert most < 30


def test_a_daily_refit_is_the_fit_from_scratch():
    x, y = smooth_series(9)
    model = solvers.Logistic(scale=False)
    for end in range(504, 524):
        again = model.fit(x[:end], y[:end]).predict(x[end : end + 1])
        assert abs(again - solvers.Logistic(scale=False).fit(x[:end], y[:end]).predict(x[end : end + 1])).max() < 1e-7
