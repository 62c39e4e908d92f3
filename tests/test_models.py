from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import random_walks
from signalframe.operators import baselines, features, folds, models, solvers
from signalframe.schemas import H7_FEATURES


def learnable(n=700, series=("FXUSDCAD", "FXEURCAD"), seed=1):
    """Rows whose label depends on x1 and x2."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in series:
        x = rng.normal(size=(n, 3))
        p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.7 * x[:, 1])))
        parts.append(pd.DataFrame({
            "series_id": s, "obs_date": pd.bdate_range("2020-01-01", periods=n).date,
            "x1": x[:, 0], "x2": x[:, 1] * 3 + 5, "x3": x[:, 2],
            "direction_7d": (rng.random(n) < p).astype("int32"), "fwd_return_7d": rng.normal(size=n),
        }))
    return pd.concat(parts, ignore_index=True)


COLUMNS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data():
    return learnable()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).persist()


def test_global_fit_equals_newton(spark, data, frame):
    model = models.train_global(frame, numeric=COLUMNS, tol=1e-12)
    z = data[COLUMNS].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    hot = np.column_stack([(data["series_id"] == s).to_numpy(float) for s in model.series])
    want = solvers.fit_logistic(np.column_stack([hot, z]), data["direction_7d"].to_numpy(float))
    found = {r["term"]: r["coef"] for r in model.coefficients(spark).collect()}
    names = ["intercept", *(f"series={s}" for s in model.series), *COLUMNS]
    # The series indicators and the intercept are only tied by the penalty: compare what they predict.
    np.testing.assert_allclose([found[c] for c in COLUMNS], want[3:], atol=1e-5)
    for i, s in enumerate(model.series):
        assert found["intercept"] + found[f"series={s}"] == pytest.approx(want[0] + want[1 + i], abs=1e-5)
    assert set(found) == set(names)
    assert model.metadata()["n_series"] == 2 and model.metadata()["n_rows"] == len(data)
    assert model.spec() == {"categorical": ["series_id"], "numeric": COLUMNS}


def test_targets_are_never_features(frame):
    model = models.train_global(frame)
    assert model.numeric == COLUMNS
    with pytest.raises(Exception):
        models.train_global(frame.drop("direction_7d"))


def test_scoring_contract(spark, frame, tmp_path):
    from pyspark.ml import PipelineModel

    model = models.train_global(frame, numeric=COLUMNS)
    extra = frame.limit(3).withColumn("series_id", F.lit("FXNEWCAD"))
    scored = models.score_global(model, frame.unionByName(extra), 0.6)
    assert scored.columns == ["obs_date", "series_id", "p_up_logreg", "action_logreg"]
    rows = scored.collect()
    assert len(rows) == frame.count() + 3
    assert {r["series_id"] for r in rows} == {"FXUSDCAD", "FXEURCAD", "FXNEWCAD"}
    for r in rows:
        assert r["action_logreg"] == ("UP" if r["p_up_logreg"] >= 0.6 - 1e-10 else "DOWN" if r["p_up_logreg"] <= 0.4 + 1e-10 else "SIDEWAYS")
    model.save(str(tmp_path / "m"))
    again = models.score_global(PipelineModel.load(str(tmp_path / "m")), frame).orderBy("series_id", "obs_date").collect()
    assert again == models.score_global(model, frame).orderBy("series_id", "obs_date").collect()


def test_newton_reaches_the_optimum():
    d = learnable(400, ("a",))
    x, y = d[COLUMNS].to_numpy(), d["direction_7d"].to_numpy(float)
    w = solvers.fit_logistic(x, y, c=1.0)

    def objective(v):
        z = v[0] + x @ v[1:]
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(v[1:] ** 2)

    best = objective(w)
    rng = np.random.default_rng(0)
    assert all(objective(w + rng.normal(scale=1e-3, size=4)) >= best for _ in range(50))
    assert solvers.fit_logistic(x, np.ones(len(y)))[0] > 0


def test_per_series_fit_and_score(spark, data, frame):
    weights = folds.fit_per_series(frame, COLUMNS, scale=True)
    scored = folds.score_per_series(frame, weights, COLUMNS)
    for s, g in data.groupby("series_id"):
        model = solvers.Logistic().fit(g[COLUMNS].to_numpy(), g["direction_7d"].to_numpy(float))
        found = scored.filter(F.col("series_id") == s).orderBy("obs_date").toPandas()["p_up"]
        np.testing.assert_allclose(found, model.predict(g[COLUMNS].to_numpy()), atol=1e-9)


def test_fold_table_equals_the_definition(spark, data, frame):
    table = {(r["series_id"], r["test_month"]): r for r in folds.fold_table(frame, min_train=300).collect()}
    want = 0
    for s, g in data.groupby("series_id"):
        month = pd.Series([d.replace(day=1) for d in g["obs_date"]])
        for m in month.unique():
            n = int((month < m).sum())
            if n < 300:
                assert (s, m) not in table
                continue
            want += 1
            row, days = table[(s, m)], g["obs_date"][(month == m).to_numpy()]
            assert (row["n_train"], row["n_test"], row["n_cal"]) == (n, len(days), 252)
            assert row["train_end"] == max(g["obs_date"][(month < m).to_numpy()])
    assert len(table) == want
    late = folds.fold_table(frame, min_train=300, embargo=7).collect()
    assert min(r["n_train"] for r in late) >= 300
    for r in late:
        days = sorted(data[data["series_id"] == r["series_id"]]["obs_date"])
        assert r["train_end"] == days[r["n_train"] - 1]


def test_walk_forward_uses_only_earlier_rows(spark, data, frame):
    """Predictions of a month do not change when its rows and later labels do."""
    before = folds.walk_forward(frame, COLUMNS, min_train=300)
    cut = dt.date(2022, 1, 1)
    flipped = frame.withColumn(
        "direction_7d", F.when(F.col("obs_date") >= F.lit(cut), 1 - F.col("direction_7d")).otherwise(F.col("direction_7d"))
    )
    after = folds.walk_forward(flipped, COLUMNS, min_train=300)

    def until(df):
        rows = df.filter(F.col("test_month") <= F.lit(cut)).select("series_id", "obs_date", "p_up", "n_train", "n_test")
        return rows.orderBy("series_id", "obs_date").collect()

    assert until(before) == until(after) and len(until(before)) > 100
    assert before.filter(F.col("train_end") >= F.col("obs_date")).count() == 0
    folds_seen = before.select("series_id", "test_month", "n_train", "n_test").distinct().count()
    assert folds_seen == folds.fold_table(frame, min_train=300).count()


def test_walk_forward_equals_separate_fits(spark, data, frame):
    found = folds.walk_forward(frame, COLUMNS, min_train=300).filter("series_id = 'FXUSDCAD'").toPandas()
    g = data[data["series_id"] == "FXUSDCAD"].reset_index(drop=True)
    for month in sorted(found["test_month"].unique())[::5]:
        train = np.array([d < month for d in g["obs_date"]])
        model = solvers.Logistic().fit(g.loc[train, COLUMNS].to_numpy(), g.loc[train, "direction_7d"].to_numpy(float))
        block = found[found["test_month"] == month].sort_values("obs_date")
        test = g["obs_date"].isin(block["obs_date"])
        np.testing.assert_allclose(block["p_up"], model.predict(g.loc[test, COLUMNS].to_numpy()), atol=1e-7)


def test_daily_steps(spark, frame):
    daily = folds.walk_forward(frame, COLUMNS, step="day", min_train=690)
    assert {r["n_train"] for r in daily.collect()} == set(range(690, 700))


def test_embargo_shortens_training(spark, frame):
    plain = folds.walk_forward(frame, COLUMNS, min_train=300).agg(F.max("n_train")).first()[0]
    assert folds.walk_forward(frame, COLUMNS, min_train=300, embargo=7).agg(F.max("n_train")).first()[0] == plain - 7


def test_too_short_histories_give_no_rows(spark, frame):
    for df in (
        folds.walk_forward(frame, COLUMNS, min_train=5000),
        folds.coefficient_history(frame, COLUMNS, min_train=5000),
        folds.walk_forward_calibrated(frame, COLUMNS, min_train=5000),
    ):
        assert df.count() == 0


def test_trees_learn(data):
    g = data[data["series_id"] == "FXUSDCAD"]
    x, y = g[COLUMNS].to_numpy(), g["direction_7d"].to_numpy(float)
    model = solvers.BoostedTrees(rounds=60).fit(x[:500], y[:500])
    p = model.predict(x[500:])

    def loss(q):
        q = np.clip(q, 1e-9, 1 - 1e-9)
        return -np.mean(y[500:] * np.log(q) + (1 - y[500:]) * np.log(1 - q))

    assert loss(p) < loss(np.full(len(p), y[:500].mean())) - 0.03
    raw_loss = [solvers.BoostedTrees(rounds=r).fit(x, y).predict(x) for r in (1, 20, 80)]
    fits = [-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) for p in raw_loss]
    assert fits == sorted(fits, reverse=True)


def test_first_split_is_the_best_one():
    """Depth 1 against a search over all cuts."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    y = (x[:, 1] + rng.normal(scale=0.5, size=120) > 0).astype(float)
    model = solvers.BoostedTrees(rounds=1, depth=1, min_leaf=20).fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-np.inf, None, None)
    for j in range(2):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if left.sum() < 20 or (~left).sum() < 20:
                continue
            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum()
            if gain > best[0]:
                best = (gain, j, left)
    raw = np.log(p / (1 - p)) + np.where(best[2], -0.05 * g[best[2]].sum() / h[best[2]].sum(), -0.05 * g[~best[2]].sum() / h[~best[2]].sum())
    np.testing.assert_allclose(model.predict(x), solvers.sigmoid(raw), atol=1e-12)


def test_isotonic_equals_spark(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p**2).astype(float)
    points, fitted = solvers.fit_isotonic(p, y)
    assert (np.diff(fitted) >= 0).all()
    grid = np.linspace(-0.2, 1.2, 57)
    cal = spark.createDataFrame(pd.DataFrame({"p_up": p, "y_true": y}))
    new = spark.createDataFrame(pd.DataFrame({"i": range(57), "p_up": grid}))
    found = models.calibrate_pooled(cal, new).orderBy("i").toPandas()["p_cal"]
    np.testing.assert_allclose(found, solvers.apply_isotonic(points, fitted, grid), atol=1e-9)


def test_calibrated_walk_forward(spark, frame):
    out = folds.walk_forward_calibrated(frame, COLUMNS).toPandas()
    raw = folds.walk_forward(frame, COLUMNS).toPandas()
    assert len(out) == len(raw) and set(out["cal_size"]) == {252}
    assert out["p_cal"].between(0, 1).all()
    merged = out.merge(raw, on=["series_id", "obs_date"])
    np.testing.assert_allclose(merged["p_raw"], merged["p_up"], atol=1e-6)
    # Order is kept within a fold.
    one = out[(out["series_id"] == "FXUSDCAD") & (out["test_month"] == out["test_month"].max())].sort_values("p_raw")
    assert (np.diff(one["p_cal"]) >= -1e-12).all()
    small = folds.walk_forward_calibrated(frame, COLUMNS, min_cal=1000).toPandas()
    np.testing.assert_allclose(small["p_raw"], small["p_cal"])


def test_coefficients(spark, frame):
    history = folds.coefficient_history(frame, COLUMNS).persist()
    assert {r[0] for r in history.select("term").distinct().collect()} == {"intercept", *COLUMNS}
    top = folds.coefficient_extremes(history, 1).filter("rank_high = 1").collect()
    assert {r["term"] for r in top} == {"x1"}
    stable = {r["term"]: r for r in folds.coefficient_stability(history).filter("series_id = 'FXUSDCAD'").collect()}
    assert stable["x1"]["share_positive"] == 1.0 and stable["x2"]["share_positive"] == 0.0


def test_importance_finds_the_signal(spark, frame):
    found = folds.tree_importance(frame, COLUMNS, rounds=60).toPandas()
    for _, g in found.groupby("series_id"):
        assert g.set_index("feature")["importance"].idxmax() == "x1"


def test_pooled_walk_forward(spark, frame):
    months = [dt.date(2022, 6, 1), dt.date(2022, 7, 1)]
    frame = frame.filter(F.col("obs_date") < F.lit(dt.date(2022, 8, 1)))
    enough = frame.filter(F.col("obs_date") < F.lit(months[0])).count()
    out = models.walk_forward_pooled(frame, lambda d: models.train_global(d, numeric=COLUMNS).pipeline, min_train=enough)
    assert sorted({r["test_month"] for r in out.select("test_month").collect()}) == months
    for r in out.select("test_month", "n_train").distinct().collect():
        assert r["n_train"] == frame.filter(F.col("obs_date") < F.lit(r["test_month"])).count()
    with pytest.raises(ValueError):
        models.walk_forward_pooled(frame, lambda d: None, min_train=10**6)


def test_pooled_trees(spark, frame):
    model = models.fit_trees(frame, COLUMNS, rounds=5)
    gain = {r["feature"]: r["importance"] for r in models.tree_gain(model, COLUMNS, spark).collect()}
    assert set(gain) == set(COLUMNS) and min(gain, key=gain.get) == "x3"


def test_momentum_uses_the_row_before(spark):
    gold = features.gold_features(spark.createDataFrame(random_walks(40, ("FXUSDCAD",))))
    rows = gold.orderBy("obs_date").collect()
    found = baselines.baseline_probabilities(gold, min_train=30).orderBy("obs_date").collect()
    assert len(found) == 10
    before = rows[29]
    want = 1 / (1 + np.exp(-1.5 * before["log_return"] / (before["rolling_std_21d"] + 1e-8)))
    assert found[0]["p_momentum"] == pytest.approx(want) and found[0]["p_coin"] == 0.5


def test_real_features_feed_the_models(spark):
    gold = features.gold_features(spark.createDataFrame(random_walks(330, ("FXUSDCAD", "FXEURCAD"), freq="B")))
    feats = features.h7_features(gold)
    scored = models.score_global(models.train_global(feats), features.h7_features(gold, drop_unlabelled=False))
    assert scored.count() == feats.count() + 14
    assert set(H7_FEATURES) <= set(feats.columns)


def test_gradient_tells_a_settled_fit_from_another(spark, walk):
    feats = features.h7_features(features.gold_features(spark.createDataFrame(random_walks(420, ("FXUSDCAD", "FXEURCAD")))))
    columns = ["ret_1d", "vol_21d", "mom_5d"]
    weights = folds.fit_per_series(feats, columns, scale=True)
    settled = folds.logistic_gradient(feats, weights, columns).collect()
    assert len(settled) == 8 and max(abs(r["gradient"]) for r in settled) < 1e-6
    moved = weights.withColumn("coef", F.col("coef") + F.when(F.col("term") == "mom_5d", 0.01).otherwise(0.0))
    assert max(abs(r["gradient"]) for r in folds.logistic_gradient(feats, moved, columns).collect()) > 1e-3
