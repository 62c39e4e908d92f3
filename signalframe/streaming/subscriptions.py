"""The subscription change feed as a stream: one state machine per key.

Changes are ``upsert`` (the first one since a delete gives created_at and token, every one the settings), ``delete`` (the key goes),
``deactivate`` (it stays, inactive) and ``verify`` (with a token). An unverified token runs out at its own time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.streaming.ordered import InEventOrder, in_event_order

STATE = "created long, updated long, settings string, token string, expires long, verified long, status string, expired boolean, live boolean"


class SubscriptionChanges(InEventOrder):
    """Puts out the key's row after every change that it makes. ``valid_ms``: how long a token is valid unless the change says."""

    def __init__(self, valid_ms: int | None = None):
        self.valid_ms = valid_ms

    def apply(self, key, state, us, tie, body):
        change = json.loads(body)
        kind = change["kind"]
        if kind == "upsert":
            state = state or {
                "created": us, "token": change.get("token") or str(tie), "verified": change.get("verified"), "expired": False,
                "expires": change.get("expires") or (us + self.valid_ms * 1000 if self.valid_ms else None),
            }
            state |= {"updated": us, "settings": change.get("settings"), "status": "active"}
        elif state is None:
            return None, []  # nothing to delete, deactivate or verify
        elif kind == "delete":
            return None, [json.dumps(state | {"updated": us, "live": False})]
        elif kind == "deactivate":
            state |= {"updated": us, "status": "inactive"}
        elif kind == "verify":
            if state["token"] is None or change.get("token") != state["token"] or state["expired"] or state["verified"] is not None:
                return state, []
            state |= {"updated": us, "verified": us, "token": None, "expires": None}
        else:
            raise ValueError(f"unknown change {kind!r}")
        return state, [json.dumps(state | {"live": True})]

    def due(self, key, state):
        if not state or state["expires"] is None or state["expired"] or state["verified"] is not None:
            return None
        return state["expires"] // 1000 + 1  # at its last moment a token is still good

    def expire(self, key, state, at):
        state |= {"expired": True}
        return state, [json.dumps(state | {"live": True})]


def change(kind: Column, settings: Column | None = None, token: Column | None = None, expires: Column | None = None, verified: Column | None = None) -> Column:
    """The text of a change, from columns; times are microseconds."""
    given = {"kind": kind, "settings": settings, "token": token, "expires": expires, "verified": verified}
    return F.to_json(F.struct(*[c.alias(n) for n, c in given.items() if c is not None]))


def subscription_changes(
    feed: DataFrame, key: str, ts: str, tiebreak: str, body: Column, late: str = "1 hour", valid_ms: int | None = None
) -> DataFrame:
    """A stream of key, us, tie and the key's row after each change (see STATE), in order per key.

    A change re-sent within ``late`` (same tiebreak) counts once. Changes later than the watermark are left out. A key's state is its row; it
    goes with a delete.
    """
    made = in_event_order(feed, SubscriptionChanges(valid_ms), key, F.lit(0), ts, tiebreak, body, late, once=True)
    return made.select(F.col("key").alias(key), "us", "tie", F.from_json("body", STATE).alias("row"))


def newest(changes: DataFrame, key: str) -> DataFrame:
    """The keys that live, with their last row, from written changes. An expiry comes before a change of the same time."""
    last = Window.partitionBy(key).orderBy(F.desc("us"), F.col("tie").desc_nulls_last())
    rows = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return rows.filter("row.live").select(key, "row.*").drop("live")
