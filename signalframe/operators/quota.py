"""Fixed-window request quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.operators.windows import exact_rank


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed window a UTC time falls in, counted from the epoch."""
    return F.window(ts, f"{seconds} seconds")["start"]


def request_quota(requests: DataFrame, key: str, ts: str, tiebreak: str, seconds: int, limit: int) -> DataFrame:
    """Each request's place in its key's window, and what the limit makes of it.

    The place comes from ``exact_rank``: a key that sends a third of all requests in one window is
    still cut over many tasks.
    """
    placed = exact_rank(
        requests.withColumn("window_start", window_start(F.col(ts), seconds)),
        [F.asc(ts), F.asc(tiebreak)],
        keys=(key, "window_start"),
        name="n",
    )
    return placed.withColumns(
        {
            "allowed": F.col("n") <= limit,
            "remaining": F.greatest(F.lit(limit) - F.col("n"), F.lit(0)),
            "reset_at": F.col("window_start") + F.expr(f"interval {seconds} seconds"),
        }
    )


def window_counts(requests: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests per key and window, with how many were over the limit; works on streams as well."""
    counts = requests.groupBy(F.window(F.col(ts), f"{seconds} seconds").alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        key,
        "n",
        F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"),
        F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"),
    )


def retained(windows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Windows that started within the last ``hours``."""
    return windows.filter(F.col("window_start") >= now - F.expr(f"interval {hours} hours"))


def newest_count(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse the running counts an update-mode stream wrote to the final one per key."""
    return updates.groupBy(*keys).agg(F.max("n").alias("n"))
