"""State machines on streams: order, late rows, own times, replays and the size of the state."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from signalframe.operators import quota
from signalframe.streaming import subscriptions
from signalframe.streaming.ordered import start_writing
from signalframe.streaming.requests import RequestPlaces, request_answers
from signalframe.streaming.subscriptions import SubscriptionChanges

START = datetime(2024, 1, 1)
HOUR = 3_600_000


class Held:
    """The part of a state handle that the machines use."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Feed:
    """A machine with one key, driven as a stream would: rows, then the timers that the watermark has passed."""

    def __init__(self, machine, key=(1, 0)):
        self.machine, self.key, self.held, self.out, self.now = machine, key, Held(), [], 0
        machine.init(self.held)

    def send(self, rows, watermark):
        self.now = watermark
        timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        if rows:
            self.out += self.machine.handleInputRows(self.key, iter([{"_us": us, "_tie": tie, "_body": body} for us, tie, body in rows]), timers)
        for at in sorted(t for t in self.held.timers if t <= watermark):
            self.held.timers.discard(at)
            self.out += self.machine.handleExpiredTimer(self.key, timers, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))


def test_requests_wait_for_the_watermark():
    feed = Feed(RequestPlaces(3600))
    feed.send([(5_000_000, 2, ""), (1_000_000, 1, "")], 0)
    assert feed.out == [] and feed.held.timers == {5000}
    feed.send([(3_000_000, 7, "")], 4000)
    assert [(r.us, r.body) for r in feed.out] == [(1_000_000, "1"), (3_000_000, "2")]
    feed.send([], 5000)
    assert [(r.us, r.body) for r in feed.out][2:] == [(5_000_000, "3")] and feed.held.timers == {HOUR}
    feed.send([], HOUR)
    assert feed.held.value is None and feed.held.timers == set()


def body(kind, **more):
    return json.dumps({"kind": kind, **more})


def rows(feed):
    return [json.loads(r.body) for r in feed.out]


def test_settings_tokens_and_deletes():
    feed = Feed(SubscriptionChanges())
    feed.send([(3, 3, body("upsert", settings="b")), (1, 1, body("delete")), (2, 2, body("upsert", settings="a")), (4, 4, body("deactivate"))], 1)
    last = rows(feed)[-1]
    assert len(feed.out) == 3 and (last["created"], last["token"], last["settings"], last["status"], last["updated"]) == (2, "2", "b", "inactive", 4)
    feed.send([(2000, 5, body("delete")), (2001, 6, body("upsert", settings="c"))], 3)
    assert [r["live"] for r in rows(feed)[-2:]] == [False, True] and rows(feed)[-1]["created"] == 2001 and rows(feed)[-1]["token"] == "6"
    feed.send([(4000, 7, body("delete"))], 5)
    assert feed.held.value is None and not feed.held.timers


@pytest.mark.parametrize("together", [True, False])
def test_a_token_expires_between_changes(together):
    """A request after the expiry does nothing, one before it verifies, whichever batch brings it."""
    first, late = (1_000, 1, body("upsert", token="t", expires=5_000_000)), (6_000_000, 2, body("verify", token="t"))
    feed = Feed(SubscriptionChanges())
    feed.send([first, late] if together else [first], 2)
    feed.send([] if together else [late], 9_000)
    assert [(r["expired"], r["verified"]) for r in rows(feed)] == [(False, None), (True, None)]
    feed = Feed(SubscriptionChanges())
    feed.send([first, (5_000_000, 2, body("verify", token="t")), (5_000_001, 3, body("verify", token="t"))], 9_000)
    assert [(r["expired"], r["verified"], r["token"]) for r in rows(feed)] == [(False, None, "t"), (False, 5_000_000, None)]


def test_unknown_keys_and_tokens():
    feed = Feed(SubscriptionChanges(valid_ms=10))
    feed.send([(1, 1, body("verify", token="x")), (2, 2, body("deactivate"))], 1)
    assert feed.out == [] and feed.held.value is None
    feed.send([(2_000, 3, body("upsert", token="t")), (2_001, 4, body("verify", token="x"))], 3)
    assert [r["verified"] for r in rows(feed)] == [None] and rows(feed)[0]["expires"] == 12_000 and feed.held.timers == {13}
    with pytest.raises(ValueError):
        feed.send([(4_000, 5, body("other"))], 5)


def requests(spark, n):
    """Some requests a minute, ten users, user 0 with a third of all."""
    made = [(k, 0 if k % 3 == 0 else k % 10, START + timedelta(seconds=17 * k)) for k in range(n)]
    return spark.createDataFrame(made, "id long, user long, at timestamp_ntz")


def run(spark, folder, batches, start):
    """Each frame is one batch of files; the query stops in between."""
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        query = start_writing(start(stream), f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch"), query


def answers(stream):
    return request_answers(stream, "user", "at", "id", 3600, 5, late="30 minutes")


def test_quota_stream(spark, tmp_path):
    """Rows up to half an hour out of order get the batch's answers; later ones none; state ends with the windows."""
    df = requests(spark, 600)  # 170 minutes
    odd = F.pmod(F.col("id"), F.lit(7)) < 3
    early = df.filter("id < 300 and id % 7 >= 3")
    delayed = df.filter((F.col("id") < 300) & odd & (F.col("id") > 250)).unionByName(df.filter("id >= 300"))
    tardy = df.filter("id = 7")
    beat = df.limit(1).select("id", F.lit(None).cast("long").alias("user"), F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz").alias("at"))
    found, query = run(spark, str(tmp_path), [early, delayed, tardy, beat], answers)
    taken = early.unionByName(delayed)
    want = quota.request_quota(taken, "user", "at", "id", 3600, 5)
    columns = ["user", "id", "n", "allowed", "remaining"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2  # the silent key that moved the watermark


def changes(stream):
    return subscriptions.subscription_changes(stream, "user", "at", "id", F.col("body"), late="30 minutes")


def test_feed_sent_again_changes_nothing(spark, tmp_path):
    kind = F.when(F.col("id") % 11 == 0, "delete").otherwise("upsert")
    df = requests(spark, 300).withColumn("body", subscriptions.change(kind, F.col("id").cast("string")))
    beat = df.limit(1).withColumns({"user": F.lit(None).cast("long"), "at": F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz")})
    cut = "id < 120"
    a, _ = run(spark, f"{tmp_path}/a", [df.filter(cut), df.filter(f"not ({cut})"), beat], changes)
    again = df.filter("id between 90 and 119").unionByName(df.filter(f"not ({cut})"))
    b, _ = run(spark, f"{tmp_path}/b", [df.filter(cut), again, df.filter("id > 250"), beat], changes)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 250
    live = {r["user"]: r for r in subscriptions.newest(a, "user").collect()}
    for user in range(10):
        own = [k for k in range(300) if (0 if k % 3 == 0 else k % 10) == user]
        since = max([k for k in own if k % 11 == 0], default=-1)
        kept = [k for k in own if k > since]
        assert (user in live) == bool(kept)
        if kept:
            assert (live[user]["token"], live[user]["settings"]) == (str(kept[0]), str(kept[-1]))
