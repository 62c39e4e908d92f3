"""Wide features, direction-model features, targets and cleaning.

All window expressions of one function share a single partitioning and ordering, so a plan has one
exchange and one sort per function whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe.functions import dates, names
from signalframe.functions.numbers import finite, ratio
from signalframe.operators.windows import by_series, full_only, in_chunks, trailing, with_full_median, with_moving_median
from signalframe.schemas import GOLD_COLUMNS, H7_FEATURES, H7_TARGETS, HORIZON, KEYS

# Rows a feature looks back and a target looks ahead; what chunked or partial runs must borrow.
GOLD_BACK, GOLD_AHEAD = 21, 5
H7_BACK, H7_AHEAD = 280, HORIZON


def load_series(df: DataFrame, series: str | None = None, numeric: tuple[str, ...] = ("value",)) -> DataFrame:
    """One series (or all), with a parsed date, numbers as doubles and no missing value."""
    rows = df if series is None else df.filter(F.col("series_id") == series)
    typed = rows.withColumn("obs_date", F.to_date("obs_date"))
    for name in numeric:
        typed = typed.withColumn(name, typed[name].try_cast("double"))
    return typed.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def flag(condition: Column) -> Column:
    """0/1, with an unknown condition counting as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def _returns(df: DataFrame, w: WindowSpec) -> DataFrame:
    value = F.col("value")
    lags = {n: F.lag(value, n).over(w) for n in (1, 2, 3, 5, 21)}
    return df.withColumns(
        {
            "prev_value": lags[1],
            "daily_return": ratio(value - lags[1], lags[1]),
            "log_return": F.ln(ratio(value, lags[1])),
            **{f"lag_{n}d": lag for n, lag in lags.items()},
            "return_5d": ratio(value - lags[5], lags[5]),
            "return_21d": ratio(value - lags[21], lags[21]),
        }
    )


def _rolling(df: DataFrame, w: WindowSpec) -> DataFrame:
    value, short, long = F.col("value"), trailing(w, 5), trailing(w, 21)
    stats = df.withColumns(
        {
            "rolling_mean_5d": F.avg("value").over(short),
            "rolling_mean_21d": F.avg("value").over(long),
            "rolling_std_5d": full_only(F.stddev_samp, "value", short, 2),
            "rolling_std_21d": full_only(F.stddev_samp, "value", long, 5),
        }
    )
    mean_5, mean_21 = F.col("rolling_mean_5d"), F.col("rolling_mean_21d")
    return stats.withColumns(
        {
            "volatility_ratio": ratio(F.col("rolling_std_5d"), F.col("rolling_std_21d")),
            "ma_crossover": ratio(mean_5, mean_21) - 1,
            "distance_from_ma21": ratio(value - mean_21, mean_21),
        }
    )


def _gold_targets(df: DataFrame, w: WindowSpec) -> DataFrame:
    value = F.col("value")
    ahead = df.withColumns(
        {
            "target_return_1d": F.ln(ratio(F.lead(value, 1).over(w), value)),
            "target_return_5d": ratio(F.lead(value, 5).over(w) - value, value),
        }
    )
    return ahead.withColumn("target_direction_1d", flag(F.col("target_return_1d") > 0))


def _gold(df: DataFrame, w: WindowSpec) -> DataFrame:
    return _gold_targets(_rolling(_returns(df, w), w), w)


def gold_features(observations: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The wide feature table: returns, lags, rolling statistics, calendar, short targets.

    ``chunk_rows`` spreads each series over runs of that many rows (same result).
    """
    df = observations
    if "base_currency" not in df.columns:
        series = F.col("series_id")
        df = df.withColumns(
            {"base_currency": names.base_currency(series), "quote_currency": names.quote_currency(series)}
        )
    wide = in_chunks(df, _gold, GOLD_BACK, GOLD_AHEAD, chunk_rows) if chunk_rows else _gold(df, by_series())
    wide = wide.withColumns(dates.calendar(F.col("obs_date")))
    return wide.select(*[c for c in GOLD_COLUMNS if c in wide.columns])


def _h7(df: DataFrame, w: WindowSpec, eps: float, h: int, moving_median: bool) -> DataFrame:
    value, ret = F.col("value"), F.col("ret_1d")
    given = ["daily_return"] if "daily_return" in df.columns else []
    ret_1d = F.col("daily_return") if given else ratio(value, F.col("prev_value")) - 1
    lagged = df.withColumns(
        {
            "ret_1d": ret_1d,
            **{f"ret_{n}d": ratio(value, F.lag(value, n).over(w)) - 1 for n in (3, 5, 10, 21)},
            f"fwd_return_{h}d": ratio(F.lead(value, h).over(w), value) - 1,
        }
    )
    rolled = lagged.withColumns(
        {
            **{f"vol_{n}d": full_only(F.stddev_samp, "ret_1d", trailing(w, n), n) for n in (5, 10, 21, 63)},
            **{f"mom_{n}d": full_only(F.avg, "ret_1d", trailing(w, n), n) for n in (5, 10, 21)},
        }
    )
    vol_21, vol_63 = F.col("vol_21d"), F.col("vol_63d")
    scaled = rolled.withColumns(
        {
            "zret_1d_21d": ratio(ret, vol_21 + eps),
            "zret_1d_63d": ratio(ret, vol_63 + eps),
            "vol_ratio_21_63": ratio(vol_21 + eps, vol_63 + eps),
        }
    )
    day = F.col("obs_date")
    with_median = with_moving_median if moving_median else with_full_median
    return with_median(scaled, "vol_21d", "vol_21_med_252", w, 252).withColumns(
        {
            "is_high_vol": flag(vol_21 > F.col("vol_21_med_252")),
            "day_of_week": dates.weekday(day),
            "month": F.month(day),
            "is_month_end": flag(dates.is_month_end(day)),
            f"direction_{h}d": flag(F.col(f"fwd_return_{h}d") > 0),
        }
    )


def h7_features(
    gold: DataFrame,
    eps: float = 0.0,
    drop_unlabelled: bool = True,
    chunk_rows: int | None = None,
    moving_median: bool = False,
) -> DataFrame:
    """21 numeric features and 2 targets per row, rows with any missing feature dropped.

    ``eps`` is added to volatilities (the research variant uses 1e-12). ``drop_unlabelled=False``
    keeps the newest rows, whose forward return is not known yet, so that they can be scored.
    ``moving_median`` updates the 252-row frame instead of sorting it per row (same result): for whole large tables; it
    starts Python workers and computes every feature, whichever are read.
    """
    missing = [c for c in ("obs_date", "series_id", "value", "prev_value") if c not in gold.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    keep = [c for c in ("obs_date", "series_id", "value", "prev_value", "daily_return") if c in gold.columns]

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return _h7(df, w, eps, HORIZON, moving_median)

    base = gold.select(*keep)
    feats = in_chunks(base, compute, H7_BACK, H7_AHEAD, chunk_rows) if chunk_rows else compute(base, by_series())
    needed = H7_FEATURES + (H7_TARGETS if drop_unlabelled else [])
    return feats.select(*KEYS, *H7_FEATURES, *H7_TARGETS).dropna(subset=needed)


# Text columns that stay text whatever they hold.
IDENTIFIERS = ("series_id", "base_currency", "quote_currency", "source", "run_id", "processed_at")


def coerce_text(df: DataFrame, skip: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """Text columns whose every value is a number become doubles; one aggregate decides which."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not texts:
        return df
    odd = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]
    counts = df.agg(*odd).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if counts[c] == 0})


def direction_target(df: DataFrame, h: int = HORIZON) -> DataFrame:
    """Forward return and direction over ``h`` rows; the last ``h`` rows of a series are dropped."""
    w = by_series()
    forward = ratio(F.lead("value", h).over(w), F.col("value")) - 1
    return (
        df.withColumn(f"target_return_{h}d", forward)
        .withColumn("_followed", F.lead(F.lit(True), h).over(w))
        .filter("_followed")
        .drop("_followed")
        .withColumn(f"target_direction_{h}d", flag(F.col(f"target_return_{h}d") > 0))
    )


def forward_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities to null, then the last known value of the series, then 0."""
    known = by_series().rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(finite(F.col(c).cast("double")), ignorenulls=True).over(known), F.lit(0.0))
        for c in columns
    }
    return df.withColumns(filled)
