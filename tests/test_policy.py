from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from signalframe.functions import names, numbers, signals
from signalframe.operators import metrics, sweep


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, p {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("p"))).collect()]


def test_decision_literals(spark):
    got = column(spark, [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0, None], lambda p: signals.decision(p, 0.6))
    assert got == ["DOWN"] * 3 + ["SIDEWAYS"] + ["UP"] * 4 + [None]


def test_boundary_slack(spark):
    values = [0.45, 0.55]
    assert column(spark, values, lambda p: signals.decision(p, 0.55)) == ["DOWN", "UP"]
    assert column(spark, values, lambda p: signals.action(p, 0.55)) == ["SIDEWAYS", "UP"]


@pytest.mark.parametrize("t", [0.5, 1.0, 0.3, 1.2])
def test_threshold_range(t):
    with pytest.raises(ValueError):
        signals.decision(F.col("p"), t)


def test_more_decisions_at_lower_thresholds(spark):
    values = [i / 100 for i in range(101)]
    acted = [
        sum(d != "SIDEWAYS" for d in column(spark, values, lambda p, t=t: signals.decision(p, t)))
        for t in (0.52, 0.6, 0.7)
    ]
    assert acted == sorted(acted, reverse=True)


def test_band_confidence_literals(spark):
    got = column(spark, [0.6, 0.7, 0.8, 1.0, 0.0, 0.3, 0.4, 0.5], lambda p: signals.band_confidence(p, 0.6))
    assert got == pytest.approx([0, 0.25, 0.5, 1, 1, 0.25, 0, 0], abs=1e-9)


def test_served_confidence(spark):
    got = column(spark, [0.6, 0.4, 0.5, None], lambda p: signals.served_confidence(p))
    assert got == pytest.approx([0.6, 0.6, 0.0, 0.0])


def test_labels(spark):
    raw = ["abstain", " UP ", "down", "hold", None, "odd"]
    assert column(spark, raw, signals.normal_label, "string") == ["SIDEWAYS", "UP", "DOWN", "HOLD", None, "ODD"]
    assert column(spark, raw, signals.signal_word, "string") == ["Neutral", "Bullish", "Bearish"] + ["Neutral"] * 3
    assert column(spark, ["UP", "down", "HOLD", None], signals.api_direction, "string") == [
        "UP", "DOWN", "ABSTAIN", "ABSTAIN",
    ]


def test_confidence_words(spark):
    got = column(spark, [0.71, 0.61, 0.55, 0.29], lambda p: signals.confidence_word(p, signals.decision(p, 0.52)))
    assert got == ["High", "Moderate", "Low", "High"]


def test_pair_names(spark):
    ids = ["FXUSDCAD", "FXEURCAD", "USDCAD", "FXUSDEUR", "FXCAD"]
    assert column(spark, ids, names.pair_of_series, "string") == ["USD_CAD", "EUR_CAD", None, None, "_CAD"]
    assert column(spark, ["USD_CAD", "FXEURCAD", "X"], names.series_of_pair, "string") == ["FXUSDCAD", "FXEURCAD", "X"]
    assert column(spark, ["usd/cad", " eur_cad "], names.normal_pair, "string") == ["USD_CAD", "EUR_CAD"]
    assert column(spark, ["a b/c!", "__x__"], names.slug, "string") == ["a_b_c", "x"]
    with pytest.raises(Exception, match="not a pair series"):
        column(spark, ["USDCAD"], lambda c: names.pair_of_series(c, strict=True), "string")


def test_bins_follow_the_grid_doubles(spark):
    got = column(spark, [0.0, 0.1, 0.3, 0.30000000000000004, 0.999, 1.0], lambda _: numbers.probability_bin("p", 10))
    assert got == [0, 1, 2, 3, 9, 9]


def test_buckets_are_right_open(spark):
    got = column(spark, [0.0, 0.4, 0.45, 0.6, 0.999, 1.0], numbers.bucket_label)
    assert got == ["[0.00,0.40)", "[0.40,0.45)", "[0.45,0.55)", "[0.60,1.00]", "[0.60,1.00]", None]


def brute_scores(rows):
    """(y, p, act) rows to the scores, by the definitions."""
    import math

    acted = [r for r in rows if r[2] != 0]
    n, k = len(rows), len(acted)
    out = {"n": n, "n_acted": k, "coverage": k / n}
    if not k:
        return {**out, "acc": None, "logloss": None, "brier": None, "ece": None}
    edges = numbers.equal_edges(10)
    bins = {}
    for y, p, _ in acted:
        b = min(max(sum(p >= e for e in edges) - 1, 0), 9)
        bins.setdefault(b, []).append((y, p))
    ece = sum(len(v) / k * abs(sum(y for y, _ in v) / len(v) - sum(p for _, p in v) / len(v)) for v in bins.values())
    return {
        **out,
        "acc": sum((a == 1) == (y == 1) for y, p, a in acted) / k,
        "logloss": sum(-math.log(p if y else 1 - p) for y, p, _ in acted) / k,
        "brier": sum((p - y) ** 2 for y, p, _ in acted) / k,
        "ece": ece,
    }


@pytest.fixture(scope="module")
def scored(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [
        (f"S{i % 3}", i // 3, int(rng.random() < 0.5), int(rng.random() < 0.4), float(np.round(rng.uniform(0.2, 0.8), 2)),
         float(np.round(rng.uniform(0.2, 0.8), 2)))
        for i in range(600)
    ]
    df = spark.createDataFrame(data, "series_id string, d int, y_true int, is_high_vol int, p_up_logreg double, p_up_tree double")
    df = df.withColumn("obs_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    return data, df.persist()


def check(row, want):
    for key, value in want.items():
        assert row[key] == (None if value is None else pytest.approx(value)), (key, row, want)


def test_sweep_matches_brute_force(scored):
    data, df = scored
    found = {(r["policy"], r["model"], r["t"], r["coverage_target"]): r.asDict() for r in sweep.policy_sweep(df).collect()}
    assert len(found) == 3 * 8 + 2 * 6
    for t in sweep.THRESHOLDS:
        def act(p):
            return 1 if p >= t else -1 if p <= 1 - t else 0

        for model, at in (("p_up_logreg", 4), ("p_up_tree", 5)):
            rows = [(r[2], r[at], act(r[at])) for r in data]
            check(found[("single_model_threshold", model, t, None)], brute_scores(rows))
        rows = [(r[2], r[4], act(r[4]) if act(r[4]) == act(r[5]) else 0) for r in data]
        check(found[("agreement_threshold", "logreg_vs_tree", t, None)], brute_scores(rows))
    for c in sweep.COVERAGES:
        for model, at in (("p_up_logreg", 4), ("p_up_tree", 5)):
            total = round(c * len(data))
            up = round(0.5 * total)
            order = sorted(data, key=lambda r: (-abs(r[at] - 0.5), r[1], r[0]))
            ups = [r for r in order if r[at] >= 0.5][:up]
            downs = [r for r in order if r[at] < 0.5][: total - up]
            rows = [(r[2], r[at], 1 if r in ups else -1 if r in downs else 0) for r in data]
            check(found[("balanced_topk_confidence", model, None, c)], brute_scores(rows))


def test_regimes_match_brute_force(scored):
    data, df = scored
    for r in sweep.regime_report(df, {"p_up_tree": "p_up_tree"}).collect():
        rows = [
            (d[2], d[5], 1 if d[5] >= r["t"] else -1 if d[5] <= 1 - r["t"] else 0)
            for d in data
            if d[3] == r["is_high_vol"]
        ]
        check(r.asDict(), brute_scores(rows))


def test_nothing_acted(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (0, 0.5, 0)], "y_true int, p double, act int").withColumn("g", F.lit(1))
    row = metrics.evaluate_acted(df, ["g"]).first()
    assert (row["n"], row["n_acted"], row["coverage"], row["acc"], row["ece"]) == (2, 0, 0.0, None, None)


def test_thresholds_without_rows(spark):
    df = spark.createDataFrame([(1, 0.55), (0, 0.45)], "y_true int, p double").withColumn("model", F.lit("m"))
    found = {r["conf_thr"]: r for r in metrics.by_threshold(df, (0.5, 0.7)).collect()}
    assert found[0.5]["coverage"] == 1.0 and found[0.5]["accuracy"] == 1.0
    assert found[0.7]["coverage"] == 0.0 and found[0.7]["accuracy"] is None


def test_certain_probabilities_have_finite_loss(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "y_true int, p double").withColumn("model", F.lit("m"))
    loss = metrics.overall(df, by=("model",)).first()["log_loss"]
    assert loss == pytest.approx(36.04 / 2, abs=0.01)


def test_sweeps_multiply_no_rows(scored):
    _, df = scored
    plan = sweep.threshold_sweep(df, {"a": "p_up_logreg"}, agreement=("p_up_logreg", "p_up_tree"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
