"""Quota answers for every request of a stream, in event-time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.operators.quota import window_start
from signalframe.streaming.ordered import InEventOrder, in_event_order


class RequestPlaces(InEventOrder):
    """Numbers the requests of one (key, window start); the state is the number answered and goes when the window ends."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def apply(self, key, state, us, tie, body):
        n = (state or 0) + 1
        return n, [str(n)]

    def due(self, key, state):
        return None if state is None else key[1] // 1000 + self.seconds * 1000

    def expire(self, key, state, at):
        return None, []


def request_answers(requests: DataFrame, key: str, ts: str, tiebreak: str, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """A stream of window_start, key, tiebreak, n, allowed, remaining, reset_at: one row per request, as ``quota.request_quota`` has them.

    A request is answered once the watermark (``late`` behind the newest) has passed it; later ones are not. See ``in_event_order``.
    """
    start = F.unix_micros(window_start(F.col("_ts"), seconds))
    made = in_event_order(requests, RequestPlaces(seconds), key, start, ts, tiebreak, F.lit(""), late)
    n, begin = F.col("body").cast("long"), F.timestamp_micros("part")
    return made.select(
        begin.alias("window_start"), F.col("key").alias(key), F.col("tie").alias(tiebreak), n.alias("n"), (n <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - n, F.lit(0)).alias("remaining"), (begin + F.expr(f"interval {seconds} seconds")).alias("reset_at"),
    )
