"""Values shared by the test modules."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def random_walks(n: int, series, start: str = "2024-01-01", freq: str = "D"):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    parts = []
    for s in series:
        days = pd.date_range(start, periods=n, freq=freq).date
        value = 1.3 * np.exp(np.cumsum(rng.normal(0, 0.005, n)))
        parts.append(pd.DataFrame({"series_id": s, "obs_date": days, "value": value}))
    return pd.concat(parts, ignore_index=True)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
