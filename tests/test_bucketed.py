from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from signalframe.sources import bucketed


@pytest.fixture()
def stored(spark, walk, tmp_path):
    df = spark.createDataFrame(walk)
    buckets = bucketed.write_bucketed(df, str(tmp_path / "walk"), 3)
    return df, str(tmp_path / "walk"), buckets


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_rows_as_written(spark, stored):
    df, path, buckets = stored
    session = bucketed.co_partitioned_session(spark)
    back = bucketed.read_bucketed(session, path, buckets)
    assert back.schema == df.schema
    assert rows(back, "series_id", "obs_date") == rows(df, "series_id", "obs_date")


def test_joins_and_windows_stay_where_they_are(spark, stored):
    df, path, buckets = stored
    session = bucketed.co_partitioned_session(spark)
    a = bucketed.read_bucketed(session, path, buckets)
    b = bucketed.read_bucketed(session, path, buckets).withColumnRenamed("value", "other")
    joined = a.join(b, ["series_id", "obs_date"]).withColumn(
        "before", F.lag("other").over(Window.partitionBy("series_id").orderBy("obs_date"))
    )
    assert "Exchange" not in plan(joined) and "Sort [" not in plan(joined)
    want = df.withColumn("before", F.lag("value").over(Window.partitionBy("series_id").orderBy("obs_date")))
    assert rows(joined.select("series_id", "obs_date", "before"), "series_id", "obs_date") == rows(
        want.select("series_id", "obs_date", "before"), "series_id", "obs_date"
    )


def test_a_folder_is_written_once(spark, stored):
    df, path, buckets = stored
    with pytest.raises(Exception, match="non-empty directory"):
        bucketed.write_bucketed(df, path, buckets)


def test_the_given_session_keeps_its_settings(spark):
    before = {name: spark.conf.get(name) for name in bucketed.SETTINGS}
    bucketed.co_partitioned_session(spark)
    assert {name: spark.conf.get(name) for name in bucketed.SETTINGS} == before


def test_null_series_and_empty_tables(spark, tmp_path):
    session = bucketed.co_partitioned_session(spark)
    odd = spark.createDataFrame([(None, "x", 1.0), (None, "y", 2.0), ("a", "x", None)], "series_id string, obs_date string, value double")
    for n, df in enumerate((odd, odd.limit(0))):
        path = str(tmp_path / f"odd{n}")
        back = bucketed.read_bucketed(session, path, bucketed.write_bucketed(df, path, 2), df.schema)
        assert rows(back, "series_id", "obs_date") == rows(df, "series_id", "obs_date")
