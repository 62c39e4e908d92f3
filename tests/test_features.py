from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import random_walks
from signalframe import contracts
from signalframe.functions import dates
from signalframe.operators import features, quality
from signalframe.schemas import GOLD_COLUMNS, H7_FEATURES, H7_TARGETS


def last(x, i, n):
    """The ``n`` values up to position ``i``, or None when they are not all known."""
    part = x[i - n + 1 : i + 1] if i >= n - 1 else []
    return part if len(part) == n and None not in part else None


def gold_by_hand(group):
    """The wide table of one series, row by row."""
    group = group.sort_values("obs_date")
    days, v = list(group["obs_date"]), [float(x) for x in group["value"]]
    out = []
    for i, day in enumerate(days):
        past = {n: v[i - n] if i >= n else None for n in (1, 2, 3, 5, 21)}
        ahead = {n: v[i + n] if i + n < len(v) else None for n in (1, 5)}
        short, long = v[max(0, i - 4) : i + 1], v[max(0, i - 20) : i + 1]
        mean_5, mean_21 = statistics.fmean(short), statistics.fmean(long)
        std_5 = statistics.stdev(short) if len(short) >= 2 else None
        std_21 = statistics.stdev(long) if len(long) >= 5 else None
        up = math.log(ahead[1] / v[i]) if ahead[1] else None
        tomorrow = day + dt.timedelta(days=1)
        yesterday = day - dt.timedelta(days=1)
        row = {"obs_date": day, "value": v[i], "prev_value": past[1]}
        row |= {f"lag_{n}d": x for n, x in past.items()}
        row |= {
            "daily_return": past[1] and (v[i] - past[1]) / past[1],
            "log_return": past[1] and math.log(v[i] / past[1]),
            "return_5d": past[5] and (v[i] - past[5]) / past[5],
            "return_21d": past[21] and (v[i] - past[21]) / past[21],
            "rolling_mean_5d": mean_5, "rolling_mean_21d": mean_21, "rolling_std_5d": std_5, "rolling_std_21d": std_21,
            "volatility_ratio": std_21 and std_5 / std_21,
            "ma_crossover": mean_5 / mean_21 - 1, "distance_from_ma21": (v[i] - mean_21) / mean_21,
            "day_of_week": day.weekday(), "day_of_month": day.day, "week_of_year": day.isocalendar()[1],
            "month": day.month, "quarter": (day.month + 2) // 3, "year": day.year,
            "is_month_start": yesterday.month != day.month, "is_month_end": tomorrow.month != day.month,
            "is_quarter_end": (tomorrow.month + 2) // 3 != (day.month + 2) // 3,
            "is_year_start": yesterday.year != day.year, "is_year_end": tomorrow.year != day.year,
            "target_return_1d": up, "target_direction_1d": int(up is not None and up > 0),
            "target_return_5d": ahead[5] and (ahead[5] - v[i]) / v[i],
        }
        out.append(row)
    return pd.DataFrame(out)


def h7_by_hand(group, eps=0.0):
    """The model inputs of one series, row by row; rows with anything missing are left out."""
    group = group.sort_values("obs_date")
    days, v = list(group["obs_date"]), [float(x) for x in group["value"]]
    r = [None] + [b / a - 1 for a, b in zip(v, v[1:])]
    vol = {n: [statistics.stdev(w) if (w := last(r, i, n)) else None for i in range(len(v))] for n in (5, 10, 21, 63)}
    out = []
    for i, day in enumerate(days):
        year = last(vol[21], i, 252)
        if year is None or i + 7 >= len(v):
            continue
        median = statistics.median(year)
        row = {"obs_date": day, "value": v[i], "ret_1d": r[i], "vol_21_med_252": median}
        row |= {f"ret_{n}d": v[i] / v[i - n] - 1 for n in (3, 5, 10, 21)}
        row |= {f"vol_{n}d": x[i] for n, x in vol.items()}
        row |= {f"mom_{n}d": statistics.fmean(last(r, i, n)) for n in (5, 10, 21)}
        row |= {f"zret_1d_{n}d": r[i] / (vol[n][i] + eps) for n in (21, 63)}
        row |= {
            "vol_ratio_21_63": (vol[21][i] + eps) / (vol[63][i] + eps), "is_high_vol": int(vol[21][i] > median),
            "day_of_week": day.weekday(), "month": day.month,
            "is_month_end": int((day + dt.timedelta(days=1)).month != day.month),
            "fwd_return_7d": v[i + 7] / v[i] - 1, "direction_7d": int(v[i + 7] > v[i]),
        }
        out.append(row)
    return pd.DataFrame(out)


def close(found, want, columns):
    assert len(found) == len(want)
    for c in columns:
        a, b = found[c].to_numpy(), want[c].to_numpy()
        if c == "obs_date":
            assert list(a) == list(b)
        else:
            np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=c)


def test_gold_equals_row_by_row(spark, walk):
    gold = features.gold_features(spark.createDataFrame(walk))
    assert gold.columns == [c for c in GOLD_COLUMNS if c in gold.columns]
    for series, group in walk.groupby("series_id"):
        found = gold.filter(F.col("series_id") == series).orderBy("obs_date").toPandas()
        want = gold_by_hand(group)
        close(found, want, want.columns)


def test_h7_equals_row_by_row(spark, walk):
    gold = features.gold_features(spark.createDataFrame(walk)).drop("daily_return")
    for eps in (0.0, 1e-12):
        feats = features.h7_features(gold, eps=eps)
        assert feats.columns == ["series_id", "obs_date", *H7_FEATURES, *H7_TARGETS]
        for series, group in walk.groupby("series_id"):
            found = feats.filter(F.col("series_id") == series).orderBy("obs_date").toPandas()
            want = h7_by_hand(group, eps)
            close(found, want, want.columns)


def test_h7_row_count_with_first_prev_value(spark, walk):
    """With the first previous value known, 300 rows leave 300 - 7 - 271."""
    rows = walk.assign(prev_value=walk.groupby("series_id")["value"].shift(1).fillna(walk["value"]))
    feats = features.h7_features(spark.createDataFrame(rows))
    assert {r["count"] for r in feats.groupBy("series_id").count().collect()} == {22}


def test_newest_rows_can_be_kept(spark, walk):
    gold = features.gold_features(spark.createDataFrame(walk))
    kept = features.h7_features(gold, drop_unlabelled=False)
    assert kept.count() - features.h7_features(gold).count() == 2 * 7
    newest = kept.orderBy(F.desc("obs_date")).first()
    assert newest["fwd_return_7d"] is None and newest["direction_7d"] == 0


def test_missing_prev_value_is_refused(spark, walk):
    with pytest.raises(ValueError, match="prev_value"):
        features.h7_features(spark.createDataFrame(walk))


def test_no_feature_looks_ahead(spark, walk):
    """Changing the last 20 values changes no feature before them."""
    changed = walk.copy()
    last = changed.groupby("series_id").cumcount() >= 280
    changed.loc[last, "value"] *= 1.5
    cut = sorted(walk["obs_date"].unique())[280]

    def before(frame):
        feats = features.h7_features(features.gold_features(spark.createDataFrame(frame)))
        return feats.filter(F.col("obs_date") < F.lit(cut)).select("series_id", *H7_FEATURES).orderBy("series_id", "obs_date").collect()

    assert before(walk) == before(changed)


def test_flat_series_gives_nulls_not_infinities(spark):
    flat = random_walks(40, ("FXUSDCAD",)).assign(value=1.0)
    row = features.gold_features(spark.createDataFrame(flat)).orderBy(F.desc("obs_date")).first()
    assert row["rolling_std_21d"] == 0.0 and row["volatility_ratio"] is None


def test_one_exchange_and_one_sort(spark, walk):
    df = spark.createDataFrame(walk)
    plan = features.h7_features(features.gold_features(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_forward_fill(spark):
    data = [("a", "2024-01-01", None), ("a", "2024-01-02", 2.0), ("a", "2024-01-03", float("inf")), ("a", "2024-01-04", None)]
    df = spark.createDataFrame(data, "series_id string, obs_date string, x double")
    assert [r["x"] for r in features.forward_filled(df, ["x"]).orderBy("obs_date").collect()] == [0.0, 2.0, 2.0, 2.0]


def test_load_series(spark):
    data = [("a", "2024-01-02", "1.5"), ("a", "2024-01-01", "bad"), ("b", "2024-01-01", "2")]
    df = spark.createDataFrame(data, "series_id string, obs_date string, value string")
    found = features.load_series(df, "a").collect()
    assert [(r["obs_date"], r["value"]) for r in found] == [(dt.date(2024, 1, 2), 1.5)]


def test_coerce_text(spark):
    df = spark.createDataFrame([("1", "1.5", "x", 1), (None, "2", "3", 2)], "run_id string, a string, b string, n int")
    found = features.coerce_text(df)
    assert dict(found.dtypes) == {"run_id": "string", "a": "double", "b": "string", "n": "int"}


def test_direction_target(spark, walk):
    found = features.direction_target(spark.createDataFrame(walk))
    for s, g in walk.groupby("series_id"):
        v = g["value"].reset_index(drop=True)
        want = (v.shift(-7) / v - 1).iloc[:-7]
        got = found.filter(F.col("series_id") == s).orderBy("obs_date").toPandas()
        np.testing.assert_allclose(got["target_return_7d"], want)
        assert got["target_direction_7d"].tolist() == (want > 0).astype(int).tolist()


def test_contracts(spark, walk):
    df = spark.createDataFrame(walk)
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.require_columns(df, ["nope"])
    with pytest.raises(contracts.ContractError, match="extra"):
        contracts.require_columns(df, ["series_id", "obs_date"], exact=True)
    feats = features.h7_features(features.gold_features(df))
    assert contracts.numeric_features(feats) == sorted(H7_FEATURES)
    assert contracts.feature_spec(["a"]) == {"categorical": [], "numeric": ["a"]}
    with pytest.raises(contracts.ContractError):
        contracts.select_features(feats, {"categorical": ["series_id"], "numeric": ["fwd_return_30d"]})


def test_predictions_contract(spark):
    schema = "obs_date date, series_id string, p_up_logreg double, action_logreg string"
    good = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 0.5, "UP")], schema)
    assert contracts.as_predictions(good).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.as_predictions(good.withColumn("more", F.lit(1)))
    bad = spark.createDataFrame([(dt.date(2024, 1, 1), None, 0.5, "UP")], schema)
    with pytest.raises(Exception, match="series_id is null"):
        contracts.as_predictions(bad).collect()


def test_null_series_is_a_violation(spark, walk):
    gold = features.gold_features(spark.createDataFrame(walk)).select("series_id", "obs_date", "value", "prev_value")
    assert contracts.gold_violations(gold).count() == 0
    extra = spark.createDataFrame([(None, dt.date(2024, 1, 1), 1.0, None)], gold.schema)
    assert [r["kind"] for r in contracts.gold_violations(gold.unionByName(extra)).collect()] == ["null_series_id"]


def test_input_range(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), 1.0) for d in range(1, 6)], "obs_date date, value double")
    assert tuple(quality.input_range(df).first()) == (5, dt.date(2024, 1, 1), dt.date(2024, 1, 5))
    assert tuple(quality.input_range(df.limit(0)).first()) == (0, None, None)
    with pytest.raises(ValueError, match="obs_date"):
        quality.input_range(df.drop("obs_date"))


def test_toronto_dates(spark):
    stamps = ["2024-01-15 05:00:00", "2024-01-15 04:59:00", "2024-07-15 03:59:00", "2024-07-15 04:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    got = [tuple(map(str, r)) for r in df.select(dates.local_date(F.col("t")), dates.local_iso(F.col("t"))).collect()]
    assert got == [
        ("2024-01-15", "2024-01-15T00:00:00-05:00"),
        ("2024-01-14", "2024-01-14T23:59:00-05:00"),
        ("2024-07-14", "2024-07-14T23:59:00-04:00"),
        ("2024-07-15", "2024-07-15T00:00:00-04:00"),
    ]


def test_as_of_utc(spark):
    texts = ["2024-01-15T14:30:00-05:00", "2024-01-15T14:30:00Z", "2024-01-15T14:30:00", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(dates.as_of_utc(F.col("t"))).collect()] == [
        "2024-01-15T19:30:00+00:00", "2024-01-15T14:30:00+00:00", "2024-01-15T14:30:00+00:00", "soon", None,
    ]


def test_wall_clock_times_are_refused(spark):
    df = spark.createDataFrame([("2024-01-15 05:00:00",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("wall"), F.col("s").cast("timestamp").alias("instant")
    )
    assert contracts.require_instant(df, "instant") is df
    with pytest.raises(contracts.ContractError, match="zone"):
        contracts.require_instant(df, "wall")
    assert str(df.select(dates.utc_wall(F.col("instant"))).first()[0]) == "2024-01-15 05:00:00"
    assert str(df.select(dates.utc_wall(dates.utc_instant(F.col("wall")))).first()[0]) == "2024-01-15 05:00:00"


def test_run_date_text(spark):
    texts = ["2024-01-15", "2024-1-5", "2024-02-30", "20240115", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(dates.valid_date_text(F.col("t"))).collect()] == [True, False, False, False, False, False]
