"""Selection by leading bits against a sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from signalframe.operators import selection, sweep
from signalframe.operators.selection import with_levels


def values(kind, n=600, seed=2):
    rng = random.Random(seed)
    make = {
        "spread": lambda: rng.random() / 2,
        "ties": lambda: rng.choice([0.0, 0.1, 0.1 + 2**-50, 0.25, 0.4999]),
        "one": lambda: 0.125,
        "close": lambda: 0.3 + rng.randrange(40) * 2**-53,
        "nulls": lambda: rng.choice([None, 0.0, rng.random() / 2]),
    }[kind]
    return [(rng.choice("ab"), i, make()) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "close", "nulls"])
@pytest.mark.parametrize("settled", [None, 3])
def test_levels(spark, kind, settled):
    rows = values(kind)
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(3)
    targets = {("a",): [0, 1, 30, 30, 200, 10_000], ("b",): [7]}
    found = with_levels(df, F.col("v"), [F.asc("id")], targets, ("g",), settled=settled)
    assert found.columns == ["g", "id", "v", "level"]
    got = {r["id"]: r["level"] for r in found.collect()}
    assert len(got) == len(rows)
    for (g,), ks in targets.items():
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        for rank, (_, i, _) in enumerate(order, 1):
            assert got[i] == sum(rank > k for k in ks)


def test_small_regions_are_sorted_only(spark, monkeypatch):
    """What is sorted are the bins of the targets, not the rows."""
    seen = []
    plain = selection.exact_rank
    monkeypatch.setattr(selection, "exact_rank", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    df = spark.range(20_000).select(F.lit("a").alias("g"), "id", (F.rand(4) / 2).alias("v"))
    with_levels(df, F.col("v"), [F.asc("id")], {("a",): [100, 5000]}, ("g",), settled=50).count()
    assert len(seen) == 1 and seen[0] <= 100


def test_groups_without_rows_or_targets(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("z", 2, 0.1)], "g string, id int, v double")
    got = {r["id"]: r["level"] for r in with_levels(df, F.col("v"), [F.asc("id")], {("a",): [1, 2], ("b",): [3]}, ("g",)).collect()}
    assert got == {1: 0, 2: 0}
    assert with_levels(df.limit(0), F.col("v"), [F.asc("id")], {("a",): [1]}, ("g",)).count() == 0


def test_no_sort_of_all_rows(spark):
    """The plan of the sweep has no range exchange over the predictions."""
    rng = random.Random(1)
    rows = [(f"s{i % 5}", i, rng.randrange(2), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "series_id string, obs_date int, y_true int, p double")
    plan = sweep.topk_sweep(df, {"m": "p"})._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
