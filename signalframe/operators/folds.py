"""Walk-forward evaluation: every block is predicted by a model that saw only earlier rows.

Per series, one group holds the series once and the group function moves the end of the training
rows forward; a join of every fold with its training rows would repeat each row once per later
month. Groups are bounded by the calendar (one row per series and date), and the number of tasks
is set explicitly, as the work per row is far larger than its bytes suggest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.dates import month_of
from signalframe.operators.solvers import BoostedTrees, Logistic, apply_isotonic, fit_isotonic
from signalframe.session import task_slots

MIN_TRAIN = 504
CAL_ROWS = 252
MIN_CAL = 200

FORECAST = (
    "series_id string, obs_date date, y_true int, p_up double, y_pred int, "
    "test_month date, train_end date, n_train int, n_test int"
)
CALIBRATED = "series_id string, obs_date date, y_true int, p_raw double, p_cal double, test_month date, cal_size int"
COEFFICIENTS = "series_id string, test_month date, n_train int, term string, coef double"
IMPORTANCE = "series_id string, feature string, importance double"


def fold_table(features: DataFrame, min_train: int = MIN_TRAIN, cal_rows: int = CAL_ROWS, embargo: int = 0) -> DataFrame:
    """Sizes and training end (date of the last training row) of every monthly fold.

    ``embargo`` leaves out that many rows before the test month, whose labels reach into it. One window numbers the rows and
    looks back to the training end; a month's first row then says all, so nothing is joined and rows are dealt by series once.
    """
    order = Window.partitionBy("series_id").orderBy("obs_date")
    placed = features.select(
        "series_id",
        "obs_date",
        month_of(F.col("obs_date")).alias("test_month"),
        F.row_number().over(order).cast("long").alias("_n"),
        F.lag("obs_date", embargo + 1).over(order).alias("_end"),
    )
    return (
        placed.groupBy("series_id", "test_month")
        .agg((F.min("_n") - 1 - embargo).alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.min_by("_end", "_n").alias("train_end"))
        .filter(F.col("n_train") >= min_train)
        .select("series_id", "test_month", "n_train", F.least("n_train", F.lit(cal_rows)).alias("n_cal"), "n_test", "train_end")
    )


def _blocks(days: pd.Series, step: str, min_train: int, embargo: int) -> Iterator[tuple[int, int, int]]:
    """(training end, test start, test stop) of each block of sorted dates."""
    if step == "day":
        starts = np.arange(len(days))
    else:
        period = pd.to_datetime(days).dt.to_period("M")
        starts = np.flatnonzero((period != period.shift()).to_numpy())
    stops = np.append(starts[1:], len(days))
    for start, stop in zip(starts, stops):
        if start - embargo >= min_train:
            yield int(start - embargo), int(start), int(stop)


def _per_series(df: DataFrame, columns: list[str], target: str, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn`` once per series on its rows in date order."""
    slots = task_slots(df.sparkSession, per_core=4)
    rows = df.select("series_id", "obs_date", F.col(target).alias("_y"), *columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("obs_date").reset_index(drop=True)
        x = group[columns].to_numpy(dtype=float)
        y = group["_y"].to_numpy(dtype=float)
        return fn(group["series_id"].iloc[0], group["obs_date"], x, y)

    return rows.repartition(slots, "series_id").groupBy("series_id").applyInPandas(run, schema)


def _model(kind: str, options: dict):
    return {"logistic": Logistic, "trees": BoostedTrees}[kind](**options)


def _months(days: pd.Series) -> list:
    return [d.replace(day=1) for d in days]


def walk_forward(
    features: DataFrame,
    columns: list[str],
    kind: str = "logistic",
    target: str = "direction_7d",
    step: str = "month",
    min_train: int = MIN_TRAIN,
    embargo: int = 0,
    **options,
) -> DataFrame:
    """Out-of-sample probabilities of every series, refitted each month (or each ``day``)."""

    def run(series, days, x, y):
        model = _model(kind, options)
        out = []
        for end, start, stop in _blocks(days, step, min_train, embargo):
            p = model.fit(x[:end], y[:end]).predict(x[start:stop])
            block = days.iloc[start:stop]
            out.append(
                pd.DataFrame(
                    {
                        "series_id": series,
                        "obs_date": block.to_numpy(),
                        "y_true": y[start:stop].astype("int32"),
                        "p_up": p,
                        "y_pred": (p >= 0.5).astype("int32"),
                        "test_month": _months(block),
                        "train_end": days.iloc[end - 1],
                        "n_train": end,
                        "n_test": stop - start,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in FORECAST.split(", ")])

    return _per_series(features, columns, target, run, FORECAST)


def coefficient_history(
    features: DataFrame, columns: list[str], target: str = "direction_7d", min_train: int = MIN_TRAIN, embargo: int = 0
) -> DataFrame:
    """Standardised logistic weights of every monthly refit, one row per term."""

    def run(series, days, x, y):
        model = Logistic()
        out = []
        for end, start, _ in _blocks(days, "month", min_train, embargo):
            model.fit(x[:end], y[:end])
            out.append(
                pd.DataFrame(
                    {
                        "series_id": series,
                        "test_month": days.iloc[start].replace(day=1),
                        "n_train": end,
                        "term": ["intercept", *columns],
                        "coef": model.weight,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])

    return _per_series(features, columns, target, run, COEFFICIENTS)


def coefficient_extremes(history: DataFrame, top: int = 10) -> DataFrame:
    """Largest and smallest weights of each series' last refit."""
    # A window rather than a join with the last month: the fits behind ``history`` run once.
    last = F.max("test_month").over(Window.partitionBy("series_id"))
    final = (
        history.filter(F.col("term") != "intercept")
        .withColumn("_last", last)
        .filter(F.col("test_month") == F.col("_last"))
        .drop("_last")
    )
    high = Window.partitionBy("series_id").orderBy(F.desc("coef"), "term")
    low = Window.partitionBy("series_id").orderBy("coef", "term")
    return (
        final.withColumn("rank_high", F.row_number().over(high))
        .withColumn("rank_low", F.row_number().over(low))
        .filter((F.col("rank_high") <= top) | (F.col("rank_low") <= top))
    )


def coefficient_stability(history: DataFrame) -> DataFrame:
    """Mean, spread and sign agreement of each weight over the refits."""
    return history.groupBy("series_id", "term").agg(
        F.count(F.lit(1)).alias("n_fits"),
        F.avg("coef").alias("mean_coef"),
        F.stddev_samp("coef").alias("std_coef"),
        F.avg((F.col("coef") > 0).cast("double")).alias("share_positive"),
    )


def walk_forward_calibrated(
    features: DataFrame,
    columns: list[str],
    kind: str = "logistic",
    target: str = "direction_7d",
    min_train: int = MIN_TRAIN,
    cal_rows: int = CAL_ROWS,
    min_cal: int = MIN_CAL,
    embargo: int = 0,
    **options,
) -> DataFrame:
    """Raw and isotonically calibrated out-of-sample probabilities.

    The calibrator of a fold sees the tail of its training rows, scored by a model fitted on the
    rows before the tail (on all training rows if too few are left). It does nothing when the
    tail is small or has one class.
    """

    def run(series, days, x, y):
        early, full = _model(kind, options), _model(kind, options)
        out = []
        for end, start, stop in _blocks(days, "month", min_train, embargo):
            tail = min(cal_rows, end)
            fit_end = end - tail if end - tail >= min_train // 2 else end
            p_cal = early.fit(x[:fit_end], y[:fit_end]).predict(x[end - tail : end])
            y_cal = y[end - tail : end]
            p = full.fit(x[:end], y[:end]).predict(x[start:stop])
            usable = tail >= min_cal and y_cal.min() != y_cal.max()
            calibrated = apply_isotonic(*fit_isotonic(p_cal, y_cal), p) if usable else p
            block = days.iloc[start:stop]
            out.append(
                pd.DataFrame(
                    {
                        "series_id": series,
                        "obs_date": block.to_numpy(),
                        "y_true": y[start:stop].astype("int32"),
                        "p_raw": p,
                        "p_cal": calibrated,
                        "test_month": _months(block),
                        "cal_size": tail,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in CALIBRATED.split(", ")])

    return _per_series(features, columns, target, run, CALIBRATED)


def tree_importance(
    features: DataFrame,
    columns: list[str],
    target: str = "direction_7d",
    rows: int = 252,
    repeats: int = 5,
    seed: int = 7,
    **options,
) -> DataFrame:
    """Mean rise in log loss when a feature is shuffled over the last ``rows`` training rows.

    The model is the one of the last monthly refit: trained on everything before the last month.
    """

    def loss(y, p):
        q = np.clip(p, 1e-15, 1 - 1e-15)
        return float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))

    def run(series, days, x, y):
        folds = list(_blocks(days, "month", 1, 0))
        if not folds:
            return pd.DataFrame(columns=[c.split()[0] for c in IMPORTANCE.split(", ")])
        end = folds[-1][0]
        model = BoostedTrees(**options).fit(x[:end], y[:end])
        x_tail, y_tail = x[max(0, end - rows) : end], y[max(0, end - rows) : end]
        base = loss(y_tail, model.predict(x_tail))
        rng = np.random.default_rng(seed)
        rises = []
        for j in range(len(columns)):
            rise = 0.0
            for _ in range(repeats):
                shuffled = x_tail.copy()
                shuffled[:, j] = rng.permutation(shuffled[:, j])
                rise += loss(y_tail, model.predict(shuffled)) - base
            rises.append(rise / repeats)
        return pd.DataFrame({"series_id": series, "feature": columns, "importance": rises})

    return _per_series(features, columns, target, run, IMPORTANCE)


def fit_per_series(features: DataFrame, columns: list[str], target: str = "direction_7d", scale: bool = False) -> DataFrame:
    """One logistic model per series on all its rows: weights as rows, on the fitted scale."""
    schema = "series_id string, term string, coef double, mean double, spread double, n_rows int"

    def run(series, days, x, y):
        model = Logistic(scale=scale).fit(x, y)
        return pd.DataFrame(
            {
                "series_id": series,
                "term": ["intercept", *columns],
                "coef": model.weight,
                "mean": [0.0, *model.mean],
                "spread": [1.0, *model.spread],
                "n_rows": len(x),
            }
        )

    return _per_series(features, columns, target, run, schema)


def score_per_series(features: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Probabilities from ``fit_per_series`` weights: one joined row of weights per series."""
    packed = weights.groupBy("series_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("term", F.struct("coef", "mean", "spread")))
        ).alias("_w")
    )
    joined = features.join(packed, "series_id")
    z = F.col("_w")["intercept"]["coef"]
    for c in columns:
        w = F.col("_w")[c]
        z = z + w["coef"] * (F.col(c) - w["mean"]) / w["spread"]
    return joined.withColumn("p_up", 1.0 / (1.0 + F.exp(-z))).drop("_w")


def logistic_gradient(features: DataFrame, weights: DataFrame, columns: list[str], target: str = "direction_7d") -> DataFrame:
    """series_id, term, n_rows, gradient of the penalised loss at ``fit_per_series`` weights; near zero where the fit has settled.

    One aggregate over the scored rows, combined before its exchange. A series with labels of one kind has no finite
    optimum: its fixed intercept leaves a gradient of up to ``n_rows`` times 1e-13.
    """
    error = F.col("p_up") - F.col(target)
    scored = score_per_series(features, weights, columns).withColumn("_error", error)
    sums = scored.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_error").alias("_total"),
        *[F.sum(F.col(c) * F.col("_error")).alias(f"_{n}") for n, c in enumerate(columns)],
    )
    terms = F.array(
        F.struct(F.lit("intercept").alias("term"), F.col("_total").alias("moment")),
        *[F.struct(F.lit(c).alias("term"), F.col(f"_{n}").alias("moment")) for n, c in enumerate(columns)],
    )
    long = sums.select("series_id", "n_rows", "_total", F.inline(terms))
    slope = (F.col("moment") - F.col("mean") * F.col("_total")) / F.col("spread") + F.col("coef")
    return (
        long.join(weights.drop("n_rows"), ["series_id", "term"])
        .withColumn("gradient", F.when(F.col("term") == "intercept", F.col("moment")).otherwise(slope))
        .select("series_id", "term", "n_rows", "gradient")
    )
