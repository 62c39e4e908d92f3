"""Logistic models over all series whose parts stay distributed.

Two fits, both by Newton steps in which Spark adds up gradients and second derivatives and the driver solves a system
as large as the shared weights:

* ``fit_folds``: the models of all monthly folds at once. Every row adds to each fold that trains on it, for that fold's own
  weights, by one matrix product per batch; one job per step serves all folds, however many there are.
* ``fit_offsets``: shared weights and one intercept per series. Given the shared weights, a series' intercept depends on
  its own rows only and is solved beside them; what the intercepts would change in the shared step is subtracted from
  the second derivatives (Schur complement). The driver never sees a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.contracts import require_columns
from signalframe.operators.folds import MIN_TRAIN
from signalframe.operators.solvers import sigmoid
from signalframe.session import durable, ship_package, task_slots

TARGET = "direction_7d"
#: Largest gradient entry at which a fit has arrived, and steps at most.
TOLERANCE, STEPS = 1e-7, 100


# --- Sums over rows


def _matrix(batch: pa.RecordBatch, first: int, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A column of ones and the columns from ``first`` on, standardised."""
    x = np.stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(len(center))], 1).astype(float)
    return np.column_stack([np.ones(len(x)), (x - center) / spread])


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the arrays ``v`` per ``k``; what reaches the driver is as large as one task's share."""
    each = parts.select("k", F.posexplode("v").alias("pos", "x"))
    out: dict[int, dict[int, float]] = {}
    for r in each.groupBy("k", "pos").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["k"], {})[r["pos"]] = r["x"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _pairs(q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(q)


def _square(upper: np.ndarray, q: int) -> np.ndarray:
    a, b = _pairs(q)
    out = np.zeros((q, q))
    out[a, b] = out[b, a] = upper
    return out


def _stat_rows(k: list, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], names=["k", "v"])


@dataclass
class _Descent:
    """Damped Newton steps of one convex function: its value decides whether a step stands."""

    at: np.ndarray
    value: float = np.inf
    step: np.ndarray | None = None
    trial: np.ndarray | None = None
    scale: float = 1.0
    done: bool = False
    steps: int = 0

    def __post_init__(self):
        self.trial = self.at.copy()

    def tell(self, value: float, gradient: np.ndarray, second: np.ndarray) -> None:
        """What was found at ``trial``; sets the next trial."""
        self.steps += 1
        if value <= self.value + 1e-12 * (1.0 + abs(value)) or self.scale < 1e-8:
            self.at, self.value, self.scale = self.trial, value, 1.0
            self.step = np.linalg.solve(second, gradient)
            if np.abs(gradient).max() < TOLERANCE or np.abs(self.step).max() < 1e-10 or self.steps >= STEPS:
                self.done = True
                return
        else:
            self.scale /= 2.0
        self.trial = self.at - self.scale * self.step


# --- All folds at once


@dataclass
class FoldModels:
    """One model per test month, and what it was trained on. All of it is as large as the number of months."""

    columns: list[str]
    target: str
    table: pd.DataFrame  # test_month, train_end, n_train, n_test
    center: np.ndarray  # over all rows
    spread: np.ndarray
    weights: np.ndarray  # per fold, of the columns standardised over all rows; first the intercept
    scaled: np.ndarray  # per fold, of the columns standardised over the fold's training rows
    jobs: int = 0

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """test_month, n_train, term, coef: weights of columns standardised over the fold's training rows."""
        terms = ["intercept", *self.columns]
        rows = [(m, int(n), t, float(w)) for m, n, own in zip(self.table["test_month"], self.table["n_train"], self.scaled) for t, w in zip(terms, own)]
        return spark.createDataFrame(rows, "test_month date, n_train long, term string, coef double")

    def predict(self, features: DataFrame) -> DataFrame:
        """Every row of a month that has a fold, scored by that fold: an expression over a table of one row per month."""
        spark = features.sparkSession
        raw = self.weights[:, 1:] / self.spread
        start = self.weights[:, 0] - raw @ self.center
        kind = "test_month date, train_end date, n_train long, n_test long, _w array<double>"
        rows = [(r.test_month, r.train_end, int(r.n_train), int(r.n_test), [float(b), *map(float, w)]) for r, b, w in zip(self.table.itertuples(), start, raw)]
        # One row per month: bounded by the calendar.
        models = F.broadcast(spark.createDataFrame(rows, kind))
        z = F.get("_w", F.lit(0))
        for n, c in enumerate(self.columns):
            z = z + F.get("_w", F.lit(n + 1)) * F.col(c).cast("double")
        p = 1.0 / (1.0 + F.exp(-z))
        month = F.trunc("obs_date", "month")
        return (
            features.withColumn("test_month", month)
            .join(models, "test_month")
            .withColumn("p_up", p)
            .select(
                "series_id", "obs_date", F.col(self.target).cast("int").alias("y_true"), "p_up",
                (F.col("p_up") >= 0.5).cast("int").alias("y_pred"), "test_month", "train_end", "n_train", "n_test",
            )
        )


def _by_date(rows: DataFrame, columns: list[str]) -> pd.DataFrame:
    """Rows, positives, means and squared deviations of every date; one row per calendar date reaches the driver."""
    stats = [s for n, c in enumerate(columns) for s in (F.avg(c).alias(f"m{n}"), F.var_pop(c).alias(f"v{n}"))]
    found = rows.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"), *stats)
    return pd.DataFrame([r.asDict() for r in found.collect()]).sort_values("obs_date", ignore_index=True)


def _running(days: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and population deviations up to and with each date."""
    n = days["n"].to_numpy(float)
    mean, var = (days[[f"{k}{i}" for i in range(width)]].to_numpy(float) for k in "mv")
    total = np.cumsum(n)
    # Around the mean of everything, so that little is lost in the squares.
    middle = (n[:, None] * mean).sum(0) / total[-1]
    shift = mean - middle
    first = np.cumsum(n[:, None] * shift, 0) / total[:, None]
    second = np.cumsum(n[:, None] * (var + shift**2), 0) / total[:, None]
    return total, first + middle, np.sqrt(np.maximum(second - first**2, 0.0))


def fit_folds(
    features: DataFrame, columns: list[str], target: str = TARGET, min_train: int = MIN_TRAIN, c: float = 1.0, embargo: int = 0
) -> FoldModels:
    """A pooled logistic model for every month that has ``min_train`` earlier rows, each fitted on all rows before the month.

    Each minimises ``|w|^2 / 2 + c * sum(loss)`` with a free intercept over columns standardised by the fold's own training rows.
    ``embargo`` leaves out the last so many dates before the month, whose labels reach into it. A fold whose labels are all the same predicts
    that label. Rows with a null in a column or the label are not used. No month with enough rows is an error.

    The driver holds one row per calendar date, and per fold a square of the number of columns.
    """
    require_columns(features, ["obs_date", "series_id", target, *columns])
    rows = features.select("obs_date", F.col(target).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in columns]).dropna()
    ship_package(features.sparkSession)
    rows = durable(rows)
    days = _by_date(rows, columns) if not rows.isEmpty() else pd.DataFrame(columns=["obs_date", "n"])
    width, q = len(columns), len(columns) + 1
    months = pd.to_datetime(days["obs_date"]).dt.to_period("M")
    first = np.flatnonzero((months != months.shift()).to_numpy())
    stop = np.append(first[1:], len(days))
    total = np.cumsum(days["n"].to_numpy(float))
    usable = [(a, b) for a, b in zip(first, stop) if a - embargo >= 1 and total[a - embargo - 1] >= max(min_train, 1)]
    if not usable:
        raise ValueError(f"no month has {min_train} earlier rows")
    total, mean, spread = _running(days, width)
    center, unit = mean[-1], np.where(spread[-1] == 0.0, 1.0, spread[-1])
    ends = np.array([a - embargo - 1 for a, _ in usable])
    epoch = pd.Timestamp("1970-01-01")
    # Fold k trains on days before cut[k].
    cut = np.array([(pd.Timestamp(days["obs_date"][e]) - epoch).days + 1 for e in ends])
    table = pd.DataFrame(
        {
            "test_month": [days["obs_date"][a].replace(day=1) for a, _ in usable],
            "train_end": [days["obs_date"][e] for e in ends],
            "n_train": total[ends].astype(int),
            "n_test": [int(days["n"][a:b].sum()) for a, b in usable],
        }
    )
    # From columns standardised over everything to those standardised over a fold's rows.
    own = np.where(spread[ends] == 0.0, 1.0, spread[ends])
    change = np.zeros((len(ends), q, q))
    change[:, 0, 0] = 1.0
    for k in range(len(ends)):
        change[k, 1:, 0] = (center - mean[ends[k]]) / own[k]
        change[k, 1:, 1:] = np.diag(unit / own[k])
    ridge = np.full(q, 1.0)
    ridge[0] = 0.0
    positives = np.cumsum(days["positives"].to_numpy(float))[ends]
    fits = [_Descent(np.zeros(q)) for _ in ends]
    for fit, y, n in zip(fits, positives, total[ends]):
        if y in (0.0, n):
            fit.at[0], fit.done = (30.0 if y else -30.0), True
    narrow = rows.select(F.unix_date("obs_date").alias("day"), "_y", *columns)
    jobs = 0
    while open_ := [k for k, f in enumerate(fits) if not f.done]:
        weights = np.stack([fits[k].trial @ change[k] for k in open_])
        sums = _added(narrow.mapInArrow(_fold_sums(weights, cut[open_], open_, center, unit), "k int, v array<double>"))
        jobs += 1
        for k in open_:
            s, w = sums[k], fits[k].trial
            gradient = c * change[k] @ s[1 : 1 + q] + ridge * w
            second = c * change[k] @ _square(s[1 + q :], q) @ change[k].T + np.diag(ridge + 1e-12)
            fits[k].tell(c * s[0] + 0.5 * float(ridge @ (w * w)), gradient, second)
    scaled = np.stack([f.at for f in fits])
    return FoldModels(columns, target, table, center, unit, np.stack([f.at @ t for f, t in zip(fits, change)]), scaled, jobs)


def _fold_sums(weights: np.ndarray, cut: np.ndarray, names: list[int], center: np.ndarray, unit: np.ndarray) -> Callable:
    """Per fold: loss, gradient and upper half of the second derivatives of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = weights.shape[1]
        a, b = _pairs(q)
        out = np.zeros((len(cut), 1 + q + len(a)))
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = _matrix(batch, 2, center, unit)
                y = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                used = batch.column(0).to_numpy()[:, None] < cut[None, :]
                z = x @ weights.T
                p = sigmoid(z)
                out[:, 0] += ((np.logaddexp(0.0, z) - y * z) * used).sum(0)
                out[:, 1 : 1 + q] += ((p - y) * used).T @ x
                out[:, 1 + q :] += (p * (1.0 - p) * used).T @ (x[:, a] * x[:, b])
        yield _stat_rows(names, out)

    return run


def walk_forward_folds(features: DataFrame, columns: list[str], target: str = TARGET, min_train: int = MIN_TRAIN, c: float = 1.0, embargo: int = 0) -> DataFrame:
    """Out-of-sample probabilities of the pooled model, refitted each month: the rows of ``FoldModels.predict``."""
    return fit_folds(features, columns, target, min_train, c, embargo).predict(features)


# --- Shared weights and an intercept per series


@dataclass
class OffsetModel:
    """Shared weights on the driver, intercepts of the series in a frame."""

    columns: list[str]
    intercept: float  # of raw columns
    weights: np.ndarray  # of raw columns
    scaled: np.ndarray  # of standardised columns; first the intercept
    offsets: DataFrame = field(repr=False)  # series_id, offset, n_rows
    jobs: int = 0

    def coefficients(self) -> DataFrame:
        """term, coef: the shared weights of standardised columns, then one row ``series_id=...`` per series."""
        spark = self.offsets.sparkSession
        rows = list(zip(["intercept", *self.columns], map(float, self.scaled)))
        each = self.offsets.select(F.concat(F.lit("series_id="), "series_id").alias("term"), F.col("offset").alias("coef"))
        return spark.createDataFrame(rows, "term string, coef double").unionByName(each)

    def predict(self, features: DataFrame, out: str = "p_up") -> DataFrame:
        """``features`` and the probability of every row; a series without rows at the fit has offset 0."""
        z = F.coalesce("_offset", F.lit(0.0)) + F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            z = z + F.lit(float(w)) * F.col(c).cast("double")
        known = self.offsets.select("series_id", F.col("offset").alias("_offset"))
        return features.join(known, "series_id", "left").withColumn(out, 1.0 / (1.0 + F.exp(-z))).drop("_offset")


def _series_parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows sorted by series, in tables that hold whole series."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0)
        # Where the batch's last series begins: what is before it, with what was kept, is whole.
        last = names[-1]
        same = pa.compute.equal(names, last).to_numpy(zero_copy_only=False)
        begin = int(np.argmax(same))
        goes_on = bool(kept) and kept[-1].column(0)[-1] == names[0]
        if begin == 0 and goes_on:
            kept.append(batch)
            continue
        if begin:
            kept.append(batch.slice(0, begin))
        if kept:
            yield pa.Table.from_batches(kept)
        kept = [batch.slice(begin)]
    if kept:
        yield pa.Table.from_batches(kept)


def _settled(z: np.ndarray, y: np.ndarray, seg: np.ndarray, starts: np.ndarray, c: float) -> np.ndarray:
    """The intercept of every series that minimises ``a^2 / 2 + c * sum(loss)`` beside ``z``: one-dimensional Newton steps, all series at once."""
    a = np.zeros(len(starts))
    for _ in range(100):
        p = sigmoid(z + a[seg])
        gradient = c * np.add.reduceat(p - y, starts) + a
        step = gradient / (c * np.add.reduceat(p * (1.0 - p), starts) + 1.0)
        a -= np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-12:
            break
    return a


def _series_sums(weight: np.ndarray, c: float, center: np.ndarray, unit: np.ndarray) -> Callable:
    """Value, gradient and second derivatives in the shared weights of a task's series, each at its own best intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(weight)
        a, b = _pairs(q)
        out = np.zeros(1 + q + len(a))
        for part in _series_parts(batches):
            batch = part.combine_chunks().to_batches()[0]
            x, y, seg, starts = _part(batch, center, unit)
            z = x @ weight
            offset = _settled(z, y, seg, starts, c)
            z = z + offset[seg]
            p = sigmoid(z)
            s = p * (1.0 - p)
            beside = c * np.add.reduceat(s[:, None] * x, starts)  # mixed derivatives, one row per series
            depth = c * np.add.reduceat(s, starts) + 1.0
            second = c * (s[:, None] * x).T @ x - (beside / depth[:, None]).T @ beside
            out[0] += c * (np.logaddexp(0.0, z) - y * z).sum() + 0.5 * (offset**2).sum()
            out[1 : 1 + q] += c * (p - y) @ x
            out[1 + q :] += second[a, b]
        yield _stat_rows([0], out[None, :])

    return run


def _part(batch: pa.RecordBatch, center: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, labels, series number of each row and first row of each series."""
    names = batch.column(0)
    new = np.r_[True, pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)] if len(names) > 1 else np.ones(1, bool)
    starts = np.flatnonzero(new)
    return _matrix(batch, 2, center, unit), batch.column(1).to_numpy(zero_copy_only=False), np.cumsum(new) - 1, starts


def fit_offsets(features: DataFrame, columns: list[str], target: str = TARGET, c: float = 1.0) -> OffsetModel:
    """L2 logistic regression over all series with standardised shared columns and one penalised intercept per series.

    Minimises ``|w|^2 / 2 + |a|^2 / 2 + c * sum(loss)`` over shared weights w, intercepts a and a free common intercept: the model
    of ``models.train_global``. Rows are dealt by series once and written; a step is one pass over them and sends the driver a square of
    the number of shared weights, however many series there are. Rows with a null in a column, the label or the series are not used;
    labels that are all the same give a common intercept of that side. No rows is an error.
    """
    require_columns(features, [target, "series_id", *columns])
    spark = features.sparkSession
    ship_package(spark)
    rows = features.select("series_id", F.col(target).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in columns]).dropna()
    # A series has at most one row per calendar date, so dealing by series gives no task more than decades of days at once.
    rows = durable(rows.repartition(task_slots(spark), "series_id").sortWithinPartitions("series_id"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), *[s for n, x in enumerate(columns) for s in (F.avg(x).alias(f"m{n}"), F.stddev_pop(x).alias(f"s{n}"))]).first()
    if not stats["n"]:
        raise ValueError("no training rows")
    center = np.array([stats[f"m{n}"] for n in range(len(columns))])
    unit = np.array([stats[f"s{n}"] or 1.0 for n in range(len(columns))])
    q = len(columns) + 1
    ridge = np.full(q, 1.0)
    ridge[0] = 0.0
    fit = _Descent(np.zeros(q))
    if stats["y"] in (0.0, stats["n"]):
        fit.at[0], fit.done = (30.0 if stats["y"] else -30.0), True
    jobs = 0
    while not fit.done:
        w = fit.trial
        s = _added(rows.mapInArrow(_series_sums(w, c, center, unit), "k int, v array<double>"))[0]
        jobs += 1
        second = _square(s[1 + q :], q) + np.diag(ridge + 1e-12)
        fit.tell(float(s[0]) + 0.5 * float(ridge @ (w * w)), s[1 : 1 + q] + ridge * w, second)
    weight = fit.at

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _series_parts(batches):
            batch = part.combine_chunks().to_batches()[0]
            x, y, seg, starts = _part(batch, center, unit)
            found = _settled(x @ weight, y, seg, starts, c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(found), pa.array(np.diff(np.r_[starts, len(y)]))], names=["series_id", "offset", "n_rows"])

    raw = weight[1:] / unit
    found = rows.mapInArrow(offsets, "series_id string, offset double, n_rows long")
    return OffsetModel(columns, float(weight[0] - raw @ center), raw, weight, found, jobs)
