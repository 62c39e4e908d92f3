"""Views over the test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.functions.numbers import ratio, sigmoid
from signalframe.operators.features import flag
from signalframe.operators.windows import by_series, full_only, trailing, with_full_median


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Daily series per return flag and line status.

    Sums of whole cents and one division give the same doubles in any order of adding. The sums
    are combined map-side, so only (series, date) sums are shuffled.
    """
    lines = table(spark, folder, "lineitem")
    # Prices have two decimals, so the nearest whole number is never a tie; rint needs no BigDecimal.
    cents = F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    units = F.sum(F.col("l_quantity").cast("long")).cast("double")
    return (
        lines.groupBy(
            F.concat(F.lit("FX"), "l_returnflag", "l_linestatus", F.lit("XCAD")).alias("series_id"),
            F.to_date("l_shipdate").alias("obs_date"),
        )
        .agg((cents / units / 100).alias("value"))
    )


def h7_base(spark: SparkSession, folder: str) -> DataFrame:
    """Just enough features for labels, regime and stand-in probabilities."""
    w, value = by_series(), F.col("value")
    lagged = observations(spark, folder).withColumns(
        {
            "prev_value": F.lag(value).over(w),
            "ret_1d": value / F.lag(value).over(w) - 1,
            "ret_5d": value / F.lag(value, 5).over(w) - 1,
            "fwd_return_7d": F.lead(value, 7).over(w) / value - 1,
        }
    )
    vol = lagged.withColumn("vol_21d", full_only(F.stddev_samp, "ret_1d", trailing(w, 21), 21))
    return (
        with_full_median(vol, "vol_21d", "vol_21_med_252", w, 252)
        .filter(F.col("fwd_return_7d").isNotNull() & F.col("vol_21_med_252").isNotNull())
        .withColumn("direction_7d", flag(F.col("fwd_return_7d") > 0))
        .withColumn("is_high_vol", flag(F.col("vol_21d") > F.col("vol_21_med_252")))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two stand-in models over ``h7_base``."""
    base = h7_base(spark, folder)

    def p(strength: float, ret: str):
        return F.round(sigmoid(ratio(F.col(ret), F.col("vol_21d")) * strength), 6)

    return base.select(
        "series_id",
        "obs_date",
        F.col("direction_7d").alias("y_true"),
        "is_high_vol",
        p(1.5, "ret_1d").alias("p_up_logreg"),
        p(0.5, "ret_5d").alias("p_up_tree"),
    )


def silver_events(spark: SparkSession, folder: str) -> DataFrame:
    """Many versions of each (series, date)."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series_id"),
        F.to_date("ts").alias("obs_date"),
        "value",
        F.col("ts").alias("ingested_at"),
        "event_id",
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequency, missing defaults, empty lists, messy and unknown pairs."""
    key = F.col("c_custkey")

    def pick(number, *values):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(number == i, v).otherwise(out)
        return out

    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.concat(F.lit("User"), key, F.lit("@Example.com")).alias("email"),
        pick(key % 3, "DAILY", "WEEKLY", "MONTHLY").alias("frequency"),
        F.when(key % 3 == 1, pick(key % 7, "MON", "TUE", "WED", "THU", "FRI")).alias("weekly_day"),
        F.when(key % 3 == 2, pick(key % 5, "FIRST_BUSINESS_DAY", "LAST_BUSINESS_DAY")).alias("monthly_timing"),
        pick(key % 4, "", "AFX_CAD", "afx/cad, nfx_cad", "ROX_CAD,ZZZ_CAD").alias("pairs_csv"),
        (F.col("c_acctbal") > 0).alias("verified"),
    )
