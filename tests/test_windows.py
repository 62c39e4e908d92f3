from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalframe.operators import features, windows
from signalframe.operators.incremental import latest_versions


def hot_frame(spark, n=3000):
    """One key holds two thirds of the rows."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 40)).otherwise("hot").alias("key"),
        (F.col("id") * 7919 % 101).alias("v"),
    )


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    """With and without merging of small partitions: without, the hot key lies in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_rank_within_keys(spark, coalescing):
    df = hot_frame(spark)
    found = windows.exact_rank(df, [F.desc("v"), F.asc("id")], keys=("key",)).toPandas()
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    want["rank"] = want.groupby("key").cumcount() + 1
    merged = found.merge(want, on=["id", "key", "v"], suffixes=("", "_want"))
    assert len(merged) == 3000 and (merged["rank"] == merged["rank_want"]).all()


def test_exact_rank_of_null_keys(spark, coalescing):
    df = hot_frame(spark).withColumn("key", F.nullif("key", F.lit("hot")))
    found = windows.exact_rank(df, [F.asc("v"), F.asc("id")], keys=("key",)).filter("key is null")
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 2001))


def test_exact_rank_overall(spark, coalescing):
    df = hot_frame(spark)
    found = windows.exact_rank(df, [F.asc("v"), F.asc("id")]).orderBy("rank").toPandas()
    want = df.toPandas().sort_values(["v", "id"])
    assert found["rank"].tolist() == list(range(1, 3001))
    assert found["id"].tolist() == want["id"].tolist()


def test_sorting_splits_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = hot_frame(spark).orderBy("key", "v", "id").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r["part"] for r in placed if r["key"] == "hot"}) > 1


def test_salted_join_equals_plain_join(spark):
    big = hot_frame(spark)
    small = big.groupBy("key").agg(F.max("v").alias("top"))
    salted = windows.salted_join(big, small, ["key"], "id").select("id", "top").orderBy("id").collect()
    assert salted == big.join(small, "key").select("id", "top").orderBy("id").collect()


def test_latest_versions_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01", "t1", "p1", 1), ("a", "2024-01-01", "t2", "p2", 2), ("a", "2024-01-01", "t2", "p3", 3)],
        "series_id string, obs_date string, ingested_at string, raw_path string, v int",
    )
    latest = latest_versions(df)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in latest.collect()] == [3]
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_chunks_equal_the_plain_window(spark, walk):
    df = spark.createDataFrame(walk)
    gold = features.gold_features(df)
    for rows in (64, 100):
        chunked = features.gold_features(df, chunk_rows=rows)
        assert chunked.orderBy("series_id", "obs_date").collect() == gold.orderBy("series_id", "obs_date").collect()
    plain = features.h7_features(gold).orderBy("series_id", "obs_date").toPandas()
    split = features.h7_features(gold, chunk_rows=290).orderBy("series_id", "obs_date").toPandas()
    pd.testing.assert_frame_equal(plain, split)


def test_chunks_must_cover_their_halo(spark, walk):
    with pytest.raises(ValueError):
        features.gold_features(spark.createDataFrame(walk), chunk_rows=10)


def test_last_rows(spark, walk):
    found = windows.last_rows(spark.createDataFrame(walk), 3).groupBy("series_id").agg(F.min("obs_date"), F.count("*"))
    assert {r[2] for r in found.collect()} == {3}


@pytest.mark.parametrize("rows", [1, 4, 5])
def test_moving_median(spark, rows):
    """Ties, nulls, NaN, infinities, a long and a short series, several batches."""
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, 1.0, 2.0]
    values = [(s, d, odd[(d * d + len(s)) % 9] if d % 3 else float(d * 37 % 11)) for s, n in (("a", 400), ("bb", 3), ("ccc", 90)) for d in range(n)]
    df = spark.createDataFrame(values, "series_id string, obs_date int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = windows.with_moving_median(df, "v", "m", windows.by_series(), rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = windows.with_full_median(df, "v", "m", windows.by_series(), rows).collect()
    assert sorted(map(repr, (r["series_id"] + f"{r['obs_date']:04d}" + str(r["m"]).replace("-0.0", "0.0") for r in found))) == sorted(
        map(repr, (r["series_id"] + f"{r['obs_date']:04d}" + str(r["m"]).replace("-0.0", "0.0") for r in want))
    )


def test_moving_median_of_an_empty_table(spark):
    df = spark.createDataFrame([], "series_id string, obs_date int, v double, m2 string")
    assert windows.with_moving_median(df, "v", "m", windows.by_series(), 5).collect() == []


def test_moving_median_in_chunks(spark, walk):
    gold = features.gold_features(spark.createDataFrame(walk))
    plain = features.h7_features(gold).orderBy("series_id", "obs_date").collect()
    assert features.h7_features(gold, chunk_rows=290, moving_median=True).orderBy("series_id", "obs_date").collect() == plain
