"""Facts of an output, observed while it is written."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from signalframe.sources import tables
from signalframe.sources.observed import fact_rows, publish_observed, read_manifest, write_observed

ROWS = [("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 3), None), (None, dt.date(2024, 1, 2), 2.0)]
SCHEMA = "series_id string, obs_date date, value double"


def check(rows):
    return sum(int(hashlib.md5(f"{s or ''}|{d}".encode()).hexdigest()[:8], 16) for s, d, _ in rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_facts(spark, tmp_path, parts):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    facts = write_observed(df, f"{tmp_path}/out", check=("series_id", "obs_date"))
    assert (facts.rows, facts.first_date, facts.last_date) == (3, "2024-01-01", "2024-01-03")
    assert facts.nulls == {"series_id": 1, "obs_date": 0, "value": 1} and facts.checksum == check(ROWS)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_partitioned_csv_and_empty_outputs(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert write_observed(df, f"{tmp_path}/csv", fmt="csv", partitions=("series_id",), header=True).rows == 3
    facts = write_observed(df.limit(0), f"{tmp_path}/none", check=("series_id",))
    assert (facts.rows, facts.first_date, facts.checksum, facts.nulls["value"]) == (0, None, None, 0)
    assert write_observed(df.drop("obs_date"), f"{tmp_path}/undated").first_date is None


def test_input_is_computed_once(spark, tmp_path):
    """What goes into the write is counted at its source: once, though written and observed."""
    spark.range(1000).withColumn("obs_date", F.lit(dt.date(2024, 1, 1))).write.parquet(f"{tmp_path}/in")
    source = Observation("source")
    df = spark.read.parquet(f"{tmp_path}/in").observe(source, F.count(F.lit(1)).alias("n"))
    manifest = publish_observed(spark, {"rows": df}, f"{tmp_path}/root", "2024-01-15")
    assert source.get["n"] == 1000 and manifest["outputs"]["rows"]["rows"] == 1000


def test_runs_are_published_whole(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    root = str(tmp_path / "root")
    manifest = publish_observed(spark, {"a": df, "b": df.limit(1)}, root, "2024-01-14", {"a": ("series_id", "obs_date")})
    assert read_manifest(spark, manifest["folder"]) == json.loads(json.dumps(manifest))
    with pytest.raises(ValueError):
        publish_observed(spark, {"a": df.limit(1), "b": df.limit(0)}, root, "2024-01-15")
    assert tables.read_latest(spark, root, "a").count() == 3
    with pytest.raises(ValueError):
        read_manifest(spark, f"{root}/nothing")
    rows = fact_rows(spark, manifest).collect()
    assert {(r["output"], r["column"]): r["nulls"] for r in rows}["a", "value"] == 1 and len(rows) == 6
    assert {r["checksum"] for r in rows if r["output"] == "a"} == {check(ROWS)}


def test_models_score_after_an_observed_write(spark, tmp_path):
    """An observation becomes part of the session; models must not take the session along."""
    from signalframe.operators import models

    rng = random.Random(1)
    rows = [(f"s{i % 2}", dt.date(2024, 1, 1) + dt.timedelta(i), rng.random(), rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, a double, direction_7d int")
    write_observed(df, f"{tmp_path}/out")
    assert models.score_global(models.train_global(df, numeric=["a"]), df).count() == 80
    assert len(models.score_global(models.train_global(df, numeric=["a"]), df).collect()) == 80
