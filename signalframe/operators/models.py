"""Pooled direction models on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.contracts import as_predictions, numeric_features, require_columns
from signalframe.functions.dates import month_of
from signalframe.functions.signals import decision
from signalframe.operators.folds import MIN_TRAIN
from signalframe.session import scratch_path

TARGET = "direction_7d"


@dataclass
class GlobalModel:
    """A fitted pipeline with what is needed to use and describe it."""

    pipeline: PipelineModel
    numeric: list[str]
    series: list[str]
    n_rows: int
    info: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    def spec(self) -> dict[str, list[str]]:
        return {"categorical": ["series_id"], "numeric": self.numeric}

    def terms(self) -> list[str]:
        return [f"series={s}" for s in self.series] + self.numeric

    def metadata(self) -> dict:
        return {
            "horizon": 7,
            "n_rows": self.n_rows,
            "n_series": len(self.series),
            "series_ids": sorted(self.series),
            "n_numeric_features": len(self.numeric),
            "target_col": TARGET,
            **self.info,
        }

    def coefficients(self, spark) -> DataFrame:
        """Weights as rows: one per series and feature, plus the intercept."""
        fitted = self.pipeline.stages[-1]
        rows = [("intercept", float(fitted.intercept))]
        rows += list(zip(self.terms(), (float(v) for v in fitted.coefficients.toArray())))
        return spark.createDataFrame(rows, "term string, coef double")


def _scaling(features: DataFrame, numeric: list[str]) -> tuple[SQLTransformer, int]:
    """Standardise with population deviations: one aggregate, then plain expressions."""
    stats = features.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
    ).first()
    if not stats["n"]:
        raise ValueError("no training rows")
    scaled = ", ".join(
        f"(cast(`{c}` as double) - {stats[f'm_{c}']!r}D) / {stats[f's_{c}'] or 1.0!r}D AS `z_{c}`" for c in numeric
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), stats["n"]


def train_global(
    features: DataFrame, target: str = TARGET, c: float = 1.0, numeric: list[str] | None = None, tol: float = 1e-8
) -> GlobalModel:
    """L2 logistic regression over all series: series indicators and standardised numbers.

    Matches a penalty ``|w|^2 / 2 + c * sum(loss)`` with a free intercept. An unknown series at
    scoring time gets no indicator. The weight vector holds one entry per series by design.
    """
    require_columns(features, [target, "series_id"])
    numeric = numeric or numeric_features(features, exclude=[target])
    if not numeric:
        raise ValueError("no numeric feature columns")
    # Every iteration runs one task per partition: as many as the cluster has cores.
    kept = features.select("series_id", target, *numeric).coalesce(features.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return _fit_global(kept, target, c, numeric, tol)
    finally:
        kept.unpersist()


def _fit_global(kept: DataFrame, target: str, c: float, numeric: list[str], tol: float) -> GlobalModel:
    scaler, n = _scaling(kept, numeric)
    stages = [
        StringIndexer(
            inputCol="series_id", outputCol="_series", handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        # The indexer's extra "unknown" level is the one dropped, so every known level keeps a weight.
        OneHotEncoder(inputCol="_series", outputCol="_series_vec", dropLast=True),
        scaler,
        VectorAssembler(inputCols=["_series_vec", *[f"z_{c}" for c in numeric]], outputCol="_x"),
        LogisticRegression(
            featuresCol="_x",
            labelCol=target,
            regParam=1.0 / (c * n),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=2000,
            tol=tol,
        ),
    ]
    fitted = Pipeline(stages=stages).fit(kept)
    # The training summary refers to the session and the training rows. Scoring would send it along, which fails once
    # the session has observed a write.
    fitted.stages[-1]._java_obj.setSummary(kept.sparkSession._jvm.scala.Option.apply(None))
    return GlobalModel(fitted, numeric, list(fitted.stages[0].labels), n)


def score_global(model: PipelineModel | GlobalModel, features: DataFrame, t: float = 0.6) -> DataFrame:
    """Predictions of every row in the four-column contract."""
    pipeline = model.pipeline if isinstance(model, GlobalModel) else model
    p = vector_to_array("probability")[1]
    scored = pipeline.transform(features).select("obs_date", "series_id", p.alias("p_up_logreg"))
    return as_predictions(scored.withColumn("action_logreg", decision(F.col("p_up_logreg"), t)))


def fit_trees(features: DataFrame, columns: list[str], target: str = TARGET, rounds: int = 300, seed: int = 7) -> PipelineModel:
    """Boosted trees over all series."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="_x"),
            GBTClassifier(
                featuresCol="_x",
                labelCol=target,
                maxDepth=3,
                stepSize=0.05,
                maxIter=rounds,
                minInstancesPerNode=20,
                seed=seed,
            ),
        ]
    ).fit(features)


def tree_gain(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """Importance by gain."""
    rows = list(zip(columns, (float(v) for v in model.stages[-1].featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature string, importance double")


def walk_forward_pooled(
    features: DataFrame,
    fit: Callable[[DataFrame], PipelineModel],
    min_train: int = MIN_TRAIN,
    target: str = TARGET,
) -> DataFrame:
    """Monthly refits of one model over all series, each a distributed fit on a filtered frame.

    The rows are stored by month in the shared folder, so that each filter reads its months only. The
    driver holds the list of months.
    """
    spark = features.sparkSession
    path = scratch_path(spark, "by-month")
    features.withColumn("_month", month_of(F.col("obs_date"))).repartition("_month").write.partitionBy("_month").parquet(path)
    base = spark.read.parquet(path)
    counts = {r["_month"]: r["n"] for r in base.groupBy("_month").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, seen = None, 0
    for month in sorted(counts):
        before, seen = seen, seen + counts[month]
        if before < min_train:
            continue
        model = fit(base.filter(F.col("_month") < F.lit(month)))
        p = vector_to_array("probability")[1]
        block = model.transform(base.filter(F.col("_month") == F.lit(month))).select(
            "series_id",
            "obs_date",
            F.col(target).alias("y_true"),
            p.alias("p_up"),
            F.col("_month").alias("test_month"),
            F.lit(before).alias("n_train"),
        )
        out = block if out is None else out.unionByName(block)
    if out is None:
        raise ValueError(f"no month has {min_train} earlier rows")
    return out


def calibrate_pooled(calibration: DataFrame, scored: DataFrame, p: str = "p_up", y: str = "y_true") -> DataFrame:
    """Isotonic calibration fitted on one frame and applied to another, as ``p_cal``."""
    rows = calibration.select(F.col(p).alias("_p"), F.col(y).cast("double").alias("_y"))
    model = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="p_cal").fit(rows)
    return model.transform(scored.withColumn("_p", F.col(p))).drop("_p")
