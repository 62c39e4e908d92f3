"""Pooled fits whose sums are distributed, against plain fits on the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from signalframe.operators import models, pooled, solvers

COLUMNS = ["a", "b", "flat"]


def made(n, series, seed=5):
    rng = np.random.default_rng(seed)
    parts = []
    for k, s in enumerate(series):
        a, b = rng.normal(3.0, 2.0, n), rng.normal(-50.0, 0.1, n)
        p = solvers.sigmoid(0.8 * (a - 3) - 6 * (b + 50) + 0.7 * (k - 1))
        parts.append(pd.DataFrame({"series_id": s, "obs_date": pd.date_range("2022-01-03", periods=n, freq="D").date, "a": a, "b": b, "flat": 4.0, "direction_7d": (rng.random(n) < p).astype("int32")}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def data():
    return made(260, ("FXUSDCAD", "FXEURCAD", "FXGBPCAD"))


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data)


def plain(train, columns=COLUMNS):
    """Weights of the columns standardised over the rows."""
    x = train[columns].to_numpy(float)
    spread = np.where(x.std(0) == 0, 1.0, x.std(0))
    return solvers.fit_logistic((x - x.mean(0)) / spread, train["direction_7d"].to_numpy(float)), x.mean(0), spread


@pytest.mark.parametrize("embargo", [0, 9])
def test_folds_equal_separate_fits(frame, data, embargo):
    model = pooled.fit_folds(frame, COLUMNS, min_train=150, embargo=embargo)
    assert len(model.table) >= 6 and model.jobs <= 15
    found = model.predict(frame).toPandas()
    days = np.array(sorted(data["obs_date"].unique()))
    for row, weights in zip(model.table.itertuples(), model.scaled):
        before = days[days < row.test_month]
        train = data[data["obs_date"] <= before[len(before) - 1 - embargo]]
        assert (row.n_train, row.train_end) == (len(train), train["obs_date"].max())
        want, mean, spread = plain(train)
        np.testing.assert_allclose(weights, want, atol=1e-6)
        test = data[[d.replace(day=1) == row.test_month for d in data["obs_date"]]]
        assert row.n_test == len(test)
        p = solvers.sigmoid(want[0] + (test[COLUMNS].to_numpy() - mean) / spread @ want[1:])
        own = found[found["test_month"] == row.test_month].sort_values(["series_id", "obs_date"])
        np.testing.assert_allclose(own["p_up"], p[np.lexsort((test["obs_date"], test["series_id"]))], atol=1e-6)
        assert own["y_true"].tolist() == test.sort_values(["series_id", "obs_date"])["direction_7d"].tolist()
    assert len(found) == model.table["n_test"].sum()


def test_last_fold_equals_spark_ml(frame, data):
    model = pooled.fit_folds(frame, ["a", "b"], min_train=150)
    last = model.table.iloc[-1]
    train = frame.filter(F.col("obs_date") < F.lit(last["test_month"]))
    s = train.agg(*[f(c).alias(f"{k}_{c}") for c in ("a", "b") for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = train.select("direction_7d", *[((F.col(c) - s[f"m_{c}"]) / s[f"s_{c}"]).alias(c) for c in ("a", "b")])
    fitted = LogisticRegression(featuresCol="x", labelCol="direction_7d", regParam=1.0 / int(last["n_train"]), standardization=False, maxIter=2000, tol=1e-14).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(scaled)
    )
    np.testing.assert_allclose(model.scaled[-1], [fitted.intercept, *fitted.coefficients.toArray()], atol=1e-6)


def test_steps_do_not_depend_on_folds(frame):
    few, many = (pooled.fit_folds(frame, ["a", "b"], min_train=n) for n in (700, 30))
    assert len(few.table) < len(many.table) and abs(few.jobs - many.jobs) <= 4


def test_coefficient_rows(spark, frame):
    model = pooled.fit_folds(frame, ["a", "b"], min_train=600)
    rows = model.coefficients(spark).collect()
    assert len(rows) == 3 * len(model.table) and {r["term"] for r in rows} == {"intercept", "a", "b"}


def test_folds_of_one_label_and_of_too_few_rows(spark, data):
    same = spark.createDataFrame(data.assign(direction_7d=1))
    assert pooled.walk_forward_folds(same, ["a"], min_train=600).agg(F.min("p_up")).first()[0] > 0.999
    with pytest.raises(ValueError):
        pooled.fit_folds(same, ["a"], min_train=10**6)
    with pytest.raises(ValueError):
        pooled.fit_folds(same.limit(0), ["a"], min_train=1)


def test_rows_with_nulls_are_left_out(spark, frame, data):
    holes = frame.unionByName(frame.limit(40).withColumn("a", F.lit(None).cast("double")).withColumn("obs_date", F.lit("2022-02-01").cast("date")))
    np.testing.assert_allclose(pooled.fit_folds(holes, ["a", "b"], min_train=400).scaled, pooled.fit_folds(frame, ["a", "b"], min_train=400).scaled, atol=1e-9)


@pytest.mark.parametrize("records", ["10000", "7"])
def test_offsets_equal_the_indicator_model(spark, frame, records):
    """A series may go on over several batches."""
    want = {r["term"]: r["coef"] for r in models.train_global(frame, numeric=["a", "b"], tol=1e-14).coefficients(spark).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        model = pooled.fit_offsets(frame, ["a", "b"])
        found = {r["term"]: r["coef"] for r in model.coefficients().collect()}
        sizes = {r["series_id"]: r["n_rows"] for r in model.offsets.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == {s: 260 for s in ("FXUSDCAD", "FXEURCAD", "FXGBPCAD")}
    for c in ("a", "b"):
        assert found[c] == pytest.approx(want[c], abs=1e-6)
    for s in sizes:
        assert found["intercept"] + found[f"series_id={s}"] == pytest.approx(want["intercept"] + want[f"series={s}"], abs=1e-6)
    assert model.jobs <= 12


def test_scores_of_known_and_new_series(spark, frame):
    model = pooled.fit_offsets(frame, ["a", "b"])
    offsets = {r["series_id"]: r["offset"] for r in model.offsets.collect()}
    rows = model.predict(frame.unionByName(frame.limit(3).withColumn("series_id", F.lit("FXNEWCAD")))).collect()
    assert len(rows) == 783
    for r in rows:
        z = model.intercept + offsets.get(r["series_id"], 0.0) + model.weights @ np.array([r["a"], r["b"]])
        assert r["p_up"] == pytest.approx(solvers.sigmoid(z), abs=1e-12)


def test_a_hundred_thousand_series(spark):
    """The driver gets sums over shared columns only; every series' intercept is where its own gradient vanishes."""
    rows = spark.range(300_000, numPartitions=4).select(
        F.concat(F.lit("s"), F.col("id") % 100_000).alias("series_id"), (F.rand(1) + F.lit(0.0)).alias("a"),
        (F.rand(2) < 0.2 + 0.5 * F.rand(1)).cast("int").alias("direction_7d"),
    )
    model = pooled.fit_offsets(rows, ["a"])
    assert model.offsets.count() == 100_000 and len(model.scaled) == 2
    each = model.predict(rows).groupBy("series_id").agg(F.sum(F.col("p_up") - F.col("direction_7d")).alias("error"))
    worst = each.join(model.offsets, "series_id").agg(F.max(F.abs(F.col("error") + F.col("offset")))).first()[0]
    assert worst < 1e-8


def test_offsets_of_nothing_and_of_one_label(spark, frame):
    with pytest.raises(ValueError):
        pooled.fit_offsets(frame.limit(0), ["a"])
    same = frame.withColumn("direction_7d", F.lit(0))
    assert pooled.fit_offsets(same, ["a"]).predict(same).agg(F.max("p_up")).first()[0] < 0.001
