from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import random_walks
from signalframe.operators import features, incremental, quality


@pytest.fixture(scope="module")
def silver(spark):
    walk = random_walks(160, ("FXUSDCAD", "FXEURCAD", "FXGBPCAD"), freq="B")
    return spark.createDataFrame(walk).persist()


def same(a, b):
    columns = sorted(b.columns)
    order = ["series_id", "obs_date"]
    return a.select(*columns).orderBy(*order).collect() == b.select(*columns).orderBy(*order).collect()


@pytest.mark.parametrize("seed", range(4))
def test_refresh_equals_full(spark, silver, seed):
    """Random restatements, inserts and new rows: the refreshed table is the full one."""
    rng = random.Random(seed)
    keys = [(r["series_id"], r["obs_date"]) for r in silver.select("series_id", "obs_date").collect()]
    keys.sort()
    restated = rng.sample(keys, 3)
    inserted = set(rng.sample(keys, 3))
    newest = {k for k in keys if k[1] >= keys[-1][1] - dt.timedelta(days=rng.choice([0, 3, 40]))}
    schema = "series_id string, obs_date date"
    restated_df = spark.createDataFrame(restated, schema).withColumn("hit", F.lit(1))
    current = (
        silver.join(F.broadcast(restated_df), ["series_id", "obs_date"], "left")
        .withColumn("value", F.when(F.col("hit") == 1, F.col("value") * 1.1).otherwise(F.col("value")))
        .drop("hit")
    )
    later = spark.createDataFrame(sorted(inserted | newest), schema)
    gold = features.gold_features(silver.join(later, ["series_id", "obs_date"], "left_anti"))
    changed = spark.createDataFrame(sorted(set(restated) | inserted | newest), schema)
    fresh = incremental.refresh_gold(current, gold, changed)
    assert same(fresh, features.gold_features(current))


def test_only_near_rows_are_recomputed(spark, silver):
    day = sorted({r["obs_date"] for r in silver.select("obs_date").collect()})[100]
    changed = spark.createDataFrame([("FXUSDCAD", day)], "series_id string, obs_date date")
    parts = incremental.affected_keys(silver, changed, 21, 5)
    assert parts.filter("affected").count() == 21 + 5 + 1
    assert parts.count() == 21 + 5 + 1 + 26
    assert {r["series_id"] for r in parts.collect()} == {"FXUSDCAD"}


def test_targets_before_new_rows_are_filled(spark, silver):
    """The rows before a new date get their forward targets, which append-only updates leave null."""
    days = sorted({r["obs_date"] for r in silver.select("obs_date").collect()})
    late = F.col("obs_date") > F.lit(days[-6])
    gold = features.gold_features(silver.filter(~late))
    fresh = incremental.refresh_gold(silver, gold, silver.filter(late))
    row = fresh.filter((F.col("obs_date") == F.lit(days[-6])) & (F.col("series_id") == "FXUSDCAD")).first()
    assert row["target_return_1d"] is not None and row["target_return_5d"] is not None


def test_merge_keep_last(spark):
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, 2.0, "x")], "series_id string, obs_date int, value double, extra string")
    new = spark.createDataFrame([("a", 2, 9.0), ("a", 3, 3.0)], "series_id string, obs_date int, value double")
    merged = incremental.merge_keep_last(old, new)
    assert sorted(map(tuple, merged.collect())) == [("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, 3.0)]


def test_watermarks(spark):
    silver = spark.createDataFrame([("a", 1, 5), ("a", 2, 7)], "series_id string, obs_date int, ingested_at int")
    marks = incremental.watermarks(silver)
    assert [tuple(r) for r in marks.collect()] == [("a", 7, 2)]
    landed = spark.createDataFrame([("a", 7), ("a", 8), ("b", 1)], "series_id string, ingested_at int")
    found = incremental.after_watermark(landed, marks).collect()
    assert sorted((r["series_id"], r["ingested_at"]) for r in found) == [("a", 8), ("b", 1)]


def test_final_state_matches_a_replay(spark):
    rng = random.Random(11)
    log = [(i, rng.choice(["hot"] * 5 + [f"k{j}" for j in range(20)]), i * 10, rng.random() < 0.2) for i in range(2000)]
    state = {}
    for _, key, at, delete in log:
        if delete:
            state.pop(key, None)
        else:
            created, _ = state.get(key, (at, at))
            state[key] = (created, at)
    df = spark.createDataFrame(log, "id int, key string, at int, gone boolean")
    found = incremental.final_state(df, "key", "at", F.col("gone"), "id")
    assert {r["key"]: (r["created_at"], r["updated_at"]) for r in found.collect()} == state


def test_changes_of_one_time_follow_their_ids(spark):
    """An upsert at the time of a delete counts when its id comes later; settings are the last, the token the first."""
    log = [(1, "a", 5, False, "x"), (2, "a", 9, True, None), (3, "a", 9, False, "y"), (4, "a", 10, False, "z"), (5, "b", 9, False, "x"), (6, "b", 9, True, None)]
    df = spark.createDataFrame(log, "id int, key string, at int, gone boolean, setting string").repartition(4)
    found = incremental.final_state(df, "key", "at", F.col("gone"), "id", ("setting",), ("id",)).collect()
    assert [tuple(r) for r in found] == [("a", 9, 10, "z", 3)]
    soft = {r["key"]: r["status"] for r in incremental.soft_state(df, "key", "at", F.col("gone"), "id").collect()}
    assert soft == {"a": "active", "b": "inactive"}


def test_verify(spark):
    now = dt.datetime(2024, 1, 10)
    data = [
        (1, "t1", dt.datetime(2024, 1, 11), None), (2, "t2", dt.datetime(2024, 1, 9), None),
        (3, "t3", None, None), (4, "t4", None, dt.datetime(2024, 1, 1)), (5, None, None, None),
    ]
    subs = spark.createDataFrame(
        [(i, t, e, v, dt.datetime(2024, 1, 1)) for i, t, e, v in data],
        "id int, verification_token string, verification_expires_at timestamp, verified_at timestamp, updated_at timestamp",
    )
    asked = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",), ("t1",), ("zz",)], "token string")
    out = {r["id"]: r for r in incremental.verify(subs, asked, F.lit(now)).collect()}
    assert [out[i]["verified_at"] == now for i in range(1, 6)] == [True, False, True, False, False]
    assert out[1]["verification_token"] is None and out[2]["verification_token"] == "t2"
    assert out[4]["verified_at"] == dt.datetime(2024, 1, 1)


def test_run_summary_and_pending(spark):
    status = spark.createDataFrame([("a", "success", 5), ("b", "no_records", 0), ("c", "no_new_files", 0)], "series_id string, status string, records long")
    row = quality.run_summary(status, quality.SILVER_OK).first()
    assert tuple(row) == (False, 1, 1, 3, 5)
    assert quality.run_summary(status.filter("status <> 'no_records'"), quality.SILVER_OK).first()["ok"]
    assert not quality.run_summary(status, quality.GOLD_OK).first()["ok"]
    keys = spark.createDataFrame([("a",), ("b",), ("d",)], "series_id string")
    assert sorted(r[0] for r in quality.pending(keys, status).collect()) == ["b", "d"]
    log = spark.createDataFrame([("a", "success", 1), ("a", "error", 2), ("b", "error", 1), ("b", "success", 2)], "series_id string, status string, at int")
    assert sorted(r[0] for r in quality.pending(keys, log, at="at").collect()) == ["a", "d"]
