"""Baselines without a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.functions.numbers import sigmoid
from signalframe.functions.signals import plain_confidence
from signalframe.operators.windows import by_series


def baseline_probabilities(
    gold: DataFrame, min_train: int = 504, strength: float = 1.5, vol: str = "rolling_std_21d", eps: float = 1e-8
) -> DataFrame:
    """Coin flip, and momentum of the row before: sigmoid of its return over its recent spread."""
    w = by_series()
    score = F.lag(F.col("log_return") / (F.col(vol) + eps)).over(w)
    rows = gold.withColumn("_rn", F.row_number().over(w)).withColumn("_p", sigmoid(score * strength))
    coin, p = F.lit(0.5), F.col("_p")
    return rows.filter(F.col("_rn") > min_train).select(
        "series_id",
        "obs_date",
        coin.alias("p_coin"),
        p.alias("p_momentum"),
        (coin >= 0.5).cast("int").alias("yhat_coin"),
        (p >= 0.5).cast("int").alias("yhat_momentum"),
        plain_confidence(coin).alias("conf_coin"),
        plain_confidence(p).alias("conf_momentum"),
    )
