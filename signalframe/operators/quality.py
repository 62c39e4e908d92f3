"""Data checks: missingness, class balance, date gaps, correlation, input ranges, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.operators.windows import by_series


def _long(df: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """One aggregated row with a column per name, turned into one row per name."""
    return df.unpivot([], [F.col(n) for n in names], key, value)


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of nulls per column, from one aggregate."""
    names = columns or df.columns
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    return _long(rates, names, "column", "null_rate")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label value."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # One row per class is left here, so the window over all of them is as small.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def gap_histogram(df: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent gaps in days between a row and the one before it in its series."""
    gap = F.date_diff("obs_date", F.lag("obs_date").over(by_series()))
    return (
        df.select(gap.alias("gap_days"))
        .filter(F.col("gap_days").isNotNull())
        .groupBy("gap_days")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "gap_days")
        .limit(top)
    )


def target_correlation(df: DataFrame, features: list[str], target: str, top: int = 10, digits: int = 6) -> DataFrame:
    """Correlation of every feature with the target; the ``top`` highest and lowest."""
    corrs = df.agg(*[F.round(F.corr(F.col(c).cast("double"), F.col(target)), digits).alias(c) for c in features])
    ranked = (
        _long(corrs, features, "feature", "corr")
        .filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
        # One row per feature: the unpartitioned windows hold as many rows as there are features.
        .withColumn("rank_high", F.row_number().over(Window.orderBy(F.desc("corr"), "feature")))
        .withColumn("rank_low", F.row_number().over(Window.orderBy("corr", "feature")))
    )
    high = ranked.filter(F.col("rank_high") <= top).select(
        F.lit("top").alias("end"), F.col("rank_high").alias("rank"), "feature", "corr"
    )
    low = ranked.filter(F.col("rank_low") <= top).select(
        F.lit("bottom").alias("end"), F.col("rank_low").alias("rank"), "feature", "corr"
    )
    return high.unionByName(low)


def input_range(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and first and last date, over everything or per key; 0 and nulls for an empty frame."""
    if "obs_date" not in df.columns:
        raise ValueError("column 'obs_date' not found")
    day = F.to_date("obs_date")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("min_obs_date"), F.max(day).alias("max_obs_date")
    )


def rows_by_series(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))


def distinct_series(df: DataFrame) -> DataFrame:
    return df.select("series_id").distinct()


def coverage_missing(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Series on one side only, with the side that lacks them. Only distinct ids are joined, once."""
    left = distinct_series(inputs).withColumn("_in", F.lit(True))
    right = distinct_series(outputs).withColumn("_out", F.lit(True))
    missing = F.when(F.col("_out").isNull(), "outputs").when(F.col("_in").isNull(), "inputs")
    return (
        left.join(right, "series_id", "full_outer")
        .select("series_id", missing.alias("missing_in"))
        .filter(F.col("missing_in").isNotNull())
    )


def compare_predictions(a: DataFrame, b: DataFrame, p_a: str, p_b: str, keys: list[str]) -> DataFrame:
    """Correlation, mean absolute difference and size of the common rows of two prediction frames."""
    joined = a.select(*keys, F.col(p_a).alias("_a")).join(b.select(*keys, F.col(p_b).alias("_b")), keys)
    return joined.agg(
        F.corr("_a", "_b").alias("corr"),
        F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


def run_summary(status: DataFrame, ok_states: tuple[str, ...], records: str = "records") -> DataFrame:
    """Roll a per-series status table up to one row."""
    state = F.col("status")
    good: Column = state.isin(*ok_states)
    return status.agg(
        F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(True)).alias("ok"),
        F.count_if(state == "success").alias("success"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(records), F.lit(0)).alias("total_records"),
    )


# States that count as a good run of each stage.
SILVER_OK = ("success", "no_new_files")
GOLD_OK = ("success", "no_new_data", "no_new_records")


def pending(keys: DataFrame, status: DataFrame, done: str = "success", at: str | None = None) -> DataFrame:
    """Keys still to do: those whose newest state by ``at`` is not ``done``; without ``at``, status has one row per key."""
    if at is not None:
        status = status.groupBy("series_id").agg(F.max_by("status", at).alias("status"))
    finished = status.filter(F.col("status") == done).select("series_id").distinct()
    return keys.join(finished, "series_id", "left_anti")
