from __future__ import annotations

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalframe.functions import dates, names
from signalframe.operators import quota, serving, subscribers
from signalframe.streaming.quota import start_quota


def preds(spark, rows, columns="series_id string, obs_date string, p_up_logreg double, p_up_tree double, decision string, confidence double"):
    return spark.createDataFrame(rows, columns).withColumn("obs_date", F.to_date("obs_date"))


def test_given_decisions_win(spark):
    df = preds(spark, [
        ("FXUSDCAD", "2024-01-01", 0.7, 0.2, "DOWN", 0.9),
        ("FXUSDCAD", "2024-01-02", 0.7, 0.2, "abstain", None),
        ("FXUSDCAD", "2024-01-03", 0.7, 0.2, None, None),
        ("FXUSDCAD", "2024-01-04", None, 0.2, " ", 0.3),
        ("FXUSDCAD", "2024-01-05", None, None, None, None),
    ])
    found = serving.latest_rows(df, 0.6).orderBy("obs_date").collect()
    assert [r["decision"] for r in found] == ["DOWN", "SIDEWAYS", "UP", "DOWN", None]
    assert [r["confidence"] for r in found] == [0.9, None, pytest.approx(0.25), pytest.approx(0.5), None]
    assert [r["action_logreg"] for r in found] == ["UP", "UP", "UP", None, None]
    assert [r["row_no"] for r in found] == [1, 2, 3, 4, 5]


def test_old_probability_column(spark):
    df = spark.createDataFrame([("FXUSDCAD", dt.date(2024, 1, 1), 0.3)], "series_id string, obs_date date, p_up_raw double")
    row = serving.latest_rows(df, 0.6).first()
    assert (row["p_up_logreg"], row["decision"], row["p_up_tree"]) == (0.3, "DOWN", None)


def test_limit_and_bad_ids(spark):
    rows = [("FXUSDCAD", f"2024-01-{d:02d}", 0.7, None, None, None) for d in range(1, 11)] + [("BAD", "2024-01-01", 0.7, None, None, None)]
    df = preds(spark, rows)
    found = serving.latest_rows(df, 0.6, limit=4)
    assert [str(r["obs_date"]) for r in found.orderBy("row_no").collect()] == [f"2024-01-{d:02d}" for d in range(7, 11)]
    assert [r[0] for r in serving.rejected_series(df).collect()] == ["BAD"]


def test_documents(spark):
    series = [f"FX{a}{b}XCAD" for a in "ABCDE" for b in "ABCDE"][:23]
    df = preds(spark, [(s, "2024-01-01", 0.7, None, None, None) for s in series])
    docs = serving.latest_documents(serving.latest_rows(df, 0.6), "abc", "h7", "2024-01-02T00:00:00Z")
    found = docs.collect()
    assert len(found) == 23 and docs.columns == ["sha", "pair", "horizon", "generated_at", "rows"]
    assert all(len(d["rows"]) == 1 and d["rows"][0]["decision"] == "UP" for d in found)


def test_history_is_padded_in_front(spark):
    rows = [("FXUSDCAD", f"2024-01-0{d}", p, None, None, None) for d, p in ((1, 0.2), (2, 0.5), (3, 0.9))]
    row = serving.signal_history(serving.latest_rows(preds(spark, rows), 0.6)).first()
    assert row["history"] == ["UP"] * 4 + ["DOWN", "SIDEWAYS", "UP"]
    assert (str(row["obs_date"]), row["direction"]) == ("2024-01-03", "UP")


def test_lookup(spark):
    rows = serving.latest_rows(preds(spark, [("FXUSDCAD", f"2024-01-0{d}", 0.7, None, None, None) for d in (1, 2)] + [("FXEURCAD", "2024-01-01", 0.2, None, None, None)]), 0.6)
    asked = spark.createDataFrame([("usd/cad",), ("EUR_CAD",), ("zzz_cad",), ("USD_CAD",)], "pair string")
    found = {r["pair"]: r for r in serving.lookup_latest(asked, rows).collect()}
    assert set(found) == {"USD_CAD", "EUR_CAD", "ZZZ_CAD"}
    assert (str(found["USD_CAD"]["obs_date"]), found["USD_CAD"]["direction"], found["USD_CAD"]["confidence"]) == ("2024-01-02", "UP", 0.7)
    assert (found["EUR_CAD"]["direction"], found["EUR_CAD"]["confidence"]) == ("DOWN", 0.8)
    empty = found["ZZZ_CAD"]
    assert (empty["direction"], empty["confidence"], empty["p_up"], empty["obs_date"]) == ("ABSTAIN", 0.0, 0.5, None)
    assert serving.lookup_latest(asked, rows, n=2).filter("pair = 'USD_CAD'").count() == 2


def test_latest_files(spark, tmp_path):
    from signalframe.sources import tables

    rows = serving.latest_rows(preds(spark, [("FXUSDCAD", "2024-01-01", 0.7, None, None, None), ("FXEURCAD", "2024-01-01", 0.2, None, None, None)]), 0.6)
    tables.write_latest(serving.latest_documents(rows, "abc", "h7", "now"), rows, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "json").iterdir() if p.is_dir()) == ["pair_dir=EUR_CAD", "pair_dir=USD_CAD"]
    doc = spark.read.json(str(tmp_path / "json")).filter("pair = 'USD_CAD'").first()
    assert doc["rows"][0]["p_up_logreg"] == 0.7
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_manifest(spark, tmp_path):
    from signalframe.sources import tables

    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "m.bin").write_bytes(b"x")
    gold = preds(spark, [("b", "2024-01-01", 0.1, 0.1, "", 0.0), ("a", "2024-01-02", 0.1, 0.1, "", 0.0), ("a", "2024-01-03", 0.1, 0.1, "", 0.0)])
    doc = serving.run_manifest(gold, gold, {"run_date": "2024-01-04"}, tables.file_facts(spark, str(tmp_path / "model"))).first()
    assert [(g["series_id"], g["rows"]) for g in doc["gold_inputs"]] == [("a", 2), ("b", 1)]
    assert doc["predictions"]["rows"] == 3 and doc["predictions"]["by_series_rows"] == {"a": 2, "b": 1}
    assert str(doc["predictions"]["max_obs_date"]) == "2024-01-03"
    assert doc["model_files"]["m.bin"]["bytes"] == 1 and doc["run_date"] == "2024-01-04"
    with pytest.raises(Exception, match="series missing in predictions: b"):
        serving.run_manifest(gold, gold.filter("series_id = 'a'"), {}).collect()


# --- subscribers ------------------------------------------------------------------------------


def due_by_hand(frequency, weekly, monthly, day):
    if day.weekday() >= 5:
        return False
    if frequency == "DAILY":
        return True
    if frequency == "WEEKLY":
        return day.weekday() == (["MON", "TUE", "WED", "THU", "FRI"].index(weekly) if weekly else 4)
    last = calendar.monthrange(day.year, day.month)[1]
    business = [d for d in range(1, last + 1) if dt.date(day.year, day.month, d).weekday() < 5]
    return day.day == (business[-1] if monthly == "LAST_BUSINESS_DAY" else business[0])


def test_due_over_a_year(spark):
    settings = [("DAILY", None, None)] + [("WEEKLY", d, None) for d in (None, "MON", "TUE", "WED", "THU", "FRI")]
    settings += [("MONTHLY", None, m) for m in (None, "FIRST_BUSINESS_DAY", "LAST_BUSINESS_DAY")]
    subs = spark.createDataFrame([(i, *s) for i, s in enumerate(settings)], "id int, frequency string, weekly_day string, monthly_timing string")
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(366)]
    found = {(str(r["run_date"]), r["id"]) for r in subscribers.due(subs, [str(d) for d in days]).collect()}
    assert found == {(str(d), i) for d in days for i, s in enumerate(settings) if due_by_hand(*s, d)}


def test_validation(spark):
    data = [
        (1, " User@Example.com ".strip(), ["USD_CAD"], "DAILY", None, None), (2, "nope", ["USD_CAD"], "DAILY", None, None),
        (3, "a@b.co", [], "DAILY", None, None), (4, "a@b.co", ["X"], "HOURLY", None, None),
        (5, "a@b.co", ["X"], "WEEKLY", None, None), (6, "a@b.co", ["X"], "MONTHLY", None, "SOMETIME"),
        (7, "a@b.co", ["X"], "WEEKLY", "MON", None), (8, None, ["X"], "DAILY", "MON", None),
    ]
    df = spark.createDataFrame(data, "id int, email string, pairs array<string>, frequency string, weekly_day string, monthly_timing string")
    found = {r["id"]: r for r in subscribers.validated(df).collect()}
    assert [found[i]["reason"] for i in range(1, 9)] == [None, "email", "pairs", "frequency", "weekly_day", "monthly_timing", None, "email"]
    assert found[1]["email"] == "user@example.com" and len(found[1]["subscription_key"]) == 16
    assert found[8]["weekly_day"] is None
    filled = {r["id"]: r for r in subscribers.validated(df, fill_weekly=True).collect()}
    assert filled[5]["accepted"] and filled[5]["weekly_day"] == "WED"


def test_active_joins_and_defaults(spark):
    accounts = spark.createDataFrame([(1, "a@b.co", dt.datetime(2024, 1, 1)), (2, "c@d.co", None), (3, "e@f.co", None)], "id int, email string, verified_at timestamp")
    settings = spark.createDataFrame([(1, "DAILY", None, None, None, None), (2, "DAILY", None, None, ["USD_CAD"], "UTC")],
                                     "subscription_id int, frequency string, weekly_day string, monthly_timing string, pairs array<string>, timezone string")
    found = {r["id"]: r for r in subscribers.active(accounts, settings).collect()}
    assert set(found) == {1, 2} and found[1]["pairs"] == [] and found[1]["timezone"] == dates.LOCAL_ZONE
    assert [r["id"] for r in subscribers.active(accounts, settings, verified_only=True).collect()] == [1]


def test_digest(spark):
    latest = spark.createDataFrame([("FXUSDCAD", dt.date(2024, 1, 1), 0.8, "UP"), ("FXEURCAD", dt.date(2024, 1, 1), 0.5, "SIDEWAYS")],
                                   "series_id string, obs_date date, p_up_logreg double, action_logreg string")
    due = spark.createDataFrame([(1, []), (2, ["USD_CAD", "FXUSDCAD"]), (3, ["ZZZ_CAD"])], "id int, pairs array<string>").withColumn("run_date", F.lit("2024-01-02").cast("date"))
    found = sorted((r["id"], r["series_id"], r["signal"], r["confidence_word"], r["probability"], r["run_date_text"], r["pair_label"]) for r in subscribers.digest_rows(due, latest).collect())
    assert found == [
        (1, "FXEURCAD", "Neutral", "Low", "50.0%", "January 02, 2024", "EUR/CAD"),
        (1, "FXUSDCAD", "Bullish", "High", "80.0%", "January 02, 2024", "USD/CAD"),
        (2, "FXUSDCAD", "Bullish", "High", "80.0%", "January 02, 2024", "USD/CAD"),
    ]


def test_pair_list(spark):
    df = spark.createDataFrame([(" usd/cad,,EUR_CAD ",), ("",)], "t string")
    assert [r[0] for r in df.select(names.pair_list(F.col("t"))).collect()] == [["USD_CAD", "EUR_CAD"], []]


# --- quotas -----------------------------------------------------------------------------------


def requests(spark, n=900):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "a", "b"]), start + dt.timedelta(seconds=rng.randrange(6 * 3600))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, key string, ts timestamp")


def test_quota_places(spark):
    rows, df = requests(spark)
    seen, want = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        w = ts.replace(minute=0, second=0)
        n = seen[(key, w)] = seen.get((key, w), 0) + 1
        want[i] = (w, n, n <= 5, max(0, 5 - n), w + dt.timedelta(hours=1))
    placed = quota.request_quota(df, "key", "ts", "id", 3600, 5)
    assert {r["id"]: (r["window_start"], r["n"], r["allowed"], r["remaining"], r["reset_at"]) for r in placed.collect()} == want


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    _, df = requests(spark)
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_quota(stream, "key", "ts", 3600, 5, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        found = quota.newest_count(spark.read.parquet(str(tmp_path / "out")), ["window_start", "key"])
        return sorted(map(tuple, found.collect()))

    want = sorted((r["window_start"], r["key"], r["n"]) for r in quota.window_counts(df, "key", "ts", 3600, 5).collect())
    assert run() == want
    assert run() == want


def test_retention(spark):
    _, df = requests(spark)
    counts = quota.window_counts(df, "key", "ts", 3600, 5)
    kept = quota.retained(counts, F.lit(dt.datetime(2024, 1, 2, 3, 0)), hours=24)
    assert {r["window_start"].hour for r in kept.collect()} == {3, 4, 5}
