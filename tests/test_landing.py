from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from signalframe.sources import landing, tables
from signalframe.streaming.silver import start_silver


def land(root, series, ingest_ts, payload, meta=None):
    day = f"{ingest_ts[:4]}-{ingest_ts[4:6]}-{ingest_ts[6:8]}"
    folder = root / "source=daily" / f"series={series}" / f"ingest_date={day}" / f"ingest_ts={ingest_ts}"
    folder.mkdir(parents=True)
    raw = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
    (folder / "observations.json.gz").write_bytes(gzip.compress(raw))
    if meta is not None:
        (folder / "meta.json").write_text(json.dumps(meta, indent=2))
    return raw


def payload(series, **values):
    return {"terms": {}, "observations": [{"d": d.replace("_", "-")[1:], series: v} for d, v in values.items()]}


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "landing"
    land(root, "FXUSDCAD", "20250115T120000Z",
         payload("FXUSDCAD", d2025_01_10={"v": "1.40"}, d2025_01_13="1.41", d2025_01_14={"v": ""}, d2025_01_15={"v": 0}),
         {"retrieved_at_utc": "2025-01-15T12:00:05+00:00", "raw_bytes": 1})
    land(root, "FXUSDCAD", "20250116T120000Z_backfill",
         payload("FXUSDCAD", d2025_01_13={"v": "1.42"}, d2025_01_16={"v": "n/a"}, d2025_13_99={"v": "1"}))
    land(root, "FXEURCAD", "20250115T120000Z", b"not json at all")
    return root


def test_scan(spark, landed):
    rows = landing.scan(spark, str(landed), "r1")
    good = {(str(r["obs_date"]), r["value"]): r for r in landing.accepted(rows).collect()}
    assert set(good) == {("2025-01-10", 1.40), ("2025-01-13", 1.41), ("2025-01-13", 1.42)}
    first = good[("2025-01-10", 1.40)]
    assert (first["base_currency"], first["quote_currency"], first["run_id"], first["source"]) == ("USD", "CAD", "r1", "daily")
    assert first["ingested_at"] == dt.datetime(2025, 1, 15, 12, 0, 5)
    # Without a sidecar the time is the directory's, whatever follows it.
    assert good[("2025-01-13", 1.42)]["ingested_at"] == dt.datetime(2025, 1, 16, 12, 0)
    bad = sorted((r["series_id"], r["reject"]) for r in landing.rejected(rows).collect())
    assert bad == [("FXEURCAD", "payload"), ("FXUSDCAD", "date"), ("FXUSDCAD", "value"), ("FXUSDCAD", "value"), ("FXUSDCAD", "value")]


def test_scan_prunes_partitions(spark, landed):
    df = landing.read_payloads(spark, str(landed)).filter(F.col("series_id") == "FXUSDCAD")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "series#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert df.count() == 2


def test_audit(spark, tmp_path):
    raw = land(tmp_path / "l", "FXUSDCAD", "20250115T120000Z", payload("FXUSDCAD", d2025_01_10="1.4"))
    row = landing.audit_payloads(landing.read_payloads(spark, str(tmp_path / "l"))).first()
    assert row["sha256_raw"] == hashlib.sha256(raw).hexdigest()
    assert row["raw_bytes"] == len(raw)
    assert row["response_keys"] == ["terms", "observations"] and row["observations_count"] == 1
    stored = landing.audit_files(spark, str(tmp_path / "l")).first()
    packed = next((tmp_path / "l").rglob("observations.json.gz")).read_bytes()
    assert stored["sha256"] == hashlib.sha256(packed).hexdigest() and stored["stored_bytes"] == len(packed)


def observations(spark, data):
    schema = "series_id string, obs_date string, value double, ingested_at string, raw_path string"
    df = spark.createDataFrame(data, schema)
    return df.withColumn("obs_date", F.to_date("obs_date")).withColumn("ingested_at", F.to_timestamp("ingested_at"))


BATCHES = [
    [("a", "2024-01-01", 1.0, "2024-01-02 00:00:00", "p1"), ("b", "2024-01-01", 2.0, "2024-01-02 00:00:00", "p1"),
     ("a", "2024-02-01", 3.0, "2024-02-02 00:00:00", "p1")],
    [("a", "2024-01-01", 1.5, "2024-01-03 00:00:00", "p2")],
    [("a", "2024-01-01", 0.5, "2024-01-01 00:00:00", "p0"), ("b", "2024-02-02", 9.0, "2024-02-03 00:00:00", "p3")],
]
WANT = [("a", "2024-01-01", 1.5), ("a", "2024-02-01", 3.0), ("b", "2024-01-01", 2.0), ("b", "2024-02-02", 9.0)]


def silver(spark, path, **filters):
    df = tables.read_silver(spark, path, **filters)
    return [(r["series_id"], str(r["obs_date"]), r["value"]) for r in df.orderBy("series_id", "obs_date").collect()]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_upsert(spark, tmp_path, grain):
    path = str(tmp_path / "silver")
    for i, batch in enumerate(BATCHES):
        tables.upsert_silver(observations(spark, batch), path, str(tmp_path / f"stage{i}"), grain=grain)
    assert silver(spark, path) == WANT
    # Replays, also of an old batch, change nothing.
    tables.upsert_silver(observations(spark, BATCHES[0]), path, str(tmp_path / "again"), grain=grain)
    assert silver(spark, path) == WANT
    assert silver(spark, path, since="2024-01-01") == [w for w in WANT if w[1] > "2024-01-01"]
    assert silver(spark, path, dates=["2024-01-01"]) == [w for w in WANT if w[1] == "2024-01-01"]


def test_crash_between_partition_writes(spark, tmp_path):
    """A partition lost while being replaced comes back from the finished stage."""
    import shutil

    path, stage = str(tmp_path / "silver"), str(tmp_path / "stage")
    tables.upsert_silver(observations(spark, BATCHES[0]), path, str(tmp_path / "s0"))
    tables.upsert_silver(observations(spark, BATCHES[1]), path, stage)
    shutil.rmtree(tmp_path / "silver" / "ds=2024-01-01")
    tables.upsert_silver(observations(spark, BATCHES[1]), path, stage)
    assert silver(spark, path) == [("a", "2024-01-01", 1.5), ("a", "2024-02-01", 3.0), ("b", "2024-01-01", 2.0)]


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = tmp_path / "silver"
    tables.upsert_silver(observations(spark, BATCHES[0]), str(path), str(tmp_path / "s0"))
    before = sorted(f.name for f in (path / "ds=2024-02-01").iterdir())
    tables.upsert_silver(observations(spark, BATCHES[1]), str(path), str(tmp_path / "s1"))
    assert sorted(f.name for f in (path / "ds=2024-02-01").iterdir()) == before


def test_stream_equals_batch(spark, landed, tmp_path):
    out, state, rejects = (str(tmp_path / n) for n in ("silver", "state", "rejects"))

    def run():
        start_silver(spark, str(landed), out, state, "r1", rejects, files_per_trigger=1).awaitTermination()
        return silver(spark, out)

    want = [("FXUSDCAD", "2025-01-10", 1.40), ("FXUSDCAD", "2025-01-13", 1.42)]
    assert run() == want
    assert spark.read.parquet(rejects).count() == 5
    assert run() == want
    # A file that arrives late by name is still taken; overlapping dates keep the newer version.
    land(landed, "FXUSDCAD", "20250114T120000Z", payload("FXUSDCAD", d2025_01_09="1.39", d2025_01_10="9.99"))
    assert run() == [("FXUSDCAD", "2025-01-09", 1.39), *want]
    assert len(list((tmp_path / "state" / "stage").iterdir())) == 1


def test_landing_round_trip(spark, tmp_path):
    data = [("daily", "FXUSDCAD", "2025-01-15", "20250115T120000Z", "2025-01-10", 1.4),
            ("daily", "FXUSDCAD", "2025-01-15", "20250115T120000Z", "2025-01-13", 1.0 / 3),
            ("daily", "FXEURCAD", "2025-01-15", "20250115T120000Z", "2025-01-10", 1.5)]
    df = spark.createDataFrame(data, "source string, series string, ingest_date string, ingest_ts string, obs_date string, value double")
    df = df.withColumn("obs_date", F.to_date("obs_date"))
    landing.write_landing(landing.build_payloads(df), str(tmp_path / "l"))
    rows = landing.scan(spark, str(tmp_path / "l"), "r", landing.WRITTEN_PAYLOADS, landing.WRITTEN_SIDECARS)
    found = sorted((r["series_id"], str(r["obs_date"]), r["value"]) for r in landing.accepted(rows).collect())
    assert found == sorted((d[1], d[4], d[5]) for d in data)
    metas = landing.read_sidecars(spark, str(tmp_path / "l"), landing.WRITTEN_SIDECARS).collect()
    assert sorted(m["observations_count"] for m in metas) == [1, 2]


def test_gold_scan_layouts(spark, tmp_path):
    df = spark.createDataFrame([("FXUSDCAD", "2024-01-01", 1.0), ("FXEURCAD", "2024-01-01", 2.0)], "series_id string, obs_date string, value double")
    root = tmp_path / "gold"
    df.filter("series_id = 'FXUSDCAD'").coalesce(1).write.parquet(str(root / "x"))
    df.filter("series_id = 'FXEURCAD'").drop("series_id").coalesce(1).write.parquet(str(root / "deep" / "series=FXEURCAD"))
    df.filter("series_id = 'FXUSDCAD'").drop("series_id").coalesce(1).write.parquet(str(root / "FXGBPCAD"))
    df.filter("series_id = 'FXUSDCAD'").drop("series_id").coalesce(1).write.parquet(str(root / "other"))
    df.coalesce(1).write.parquet(str(root / "mixed"))
    (root / "broken.parquet").write_bytes(b"PAR1 nothing")
    found = tables.scan_gold_files(spark, str(root))
    assert sorted(r["series_id"] for r in found.collect()) == ["FXEURCAD", "FXGBPCAD", "FXUSDCAD", "other"]
    rejects = {(r["file"].split("/")[-2], r["reason"]) for r in tables.gold_file_rejects(spark, str(root)).collect()}
    assert rejects == {("mixed", "mixed"), ("gold", "no rows")}


def test_gold_replaces_whole_series(spark, tmp_path):
    schema = "series_id string, obs_date string, value double"
    both = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 3.0)], schema)
    tables.write_gold(both, str(tmp_path / "g"))
    tables.write_gold(spark.createDataFrame([("a", "3", 4.0)], schema), str(tmp_path / "g"))
    found = sorted((r["series_id"], r["obs_date"]) for r in tables.read_gold(spark, str(tmp_path / "g")).collect())
    assert found == [("a", "3"), ("b", "1")]
    assert tables.read_gold(spark, str(tmp_path / "g"), ["b"]).count() == 1


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    tables.publish_run(spark, {"predictions": spark.range(3)}, root, "2024-01-14")
    with pytest.raises(ValueError, match="missing or empty"):
        tables.publish_run(spark, {"predictions": spark.range(5), "manifest": spark.range(0)}, root, "2024-01-15")
    assert tables.read_latest(spark, root, "predictions").count() == 3
    tables.publish_run(spark, {"predictions": spark.range(4)}, root, "2024-01-15")
    assert tables.read_latest(spark, root, "predictions").count() == 4


def test_same_date_again_leaves_latest_whole(spark, tmp_path):
    """A refused and a failing second run of one date: readers still see the first."""
    root = str(tmp_path)
    tables.publish_run(spark, {"predictions": spark.range(3), "manifest": spark.range(2)}, root, "2024-01-15")
    with pytest.raises(ValueError, match="missing or empty"):
        tables.publish_run(spark, {"predictions": spark.range(9), "manifest": spark.range(0)}, root, "2024-01-15")
    with pytest.raises(Exception, match="on purpose"):
        bad = spark.range(4).select(F.raise_error(F.lit("on purpose")).cast("long").alias("id"))
        tables.publish_run(spark, {"predictions": bad, "manifest": spark.range(1)}, root, "2024-01-15")
    assert [tables.read_latest(spark, root, n).count() for n in ("predictions", "manifest")] == [3, 2]


def test_another_batch_on_a_used_stage(spark, tmp_path):
    path, stage = str(tmp_path / "silver"), str(tmp_path / "stage")
    tables.upsert_silver(observations(spark, BATCHES[0]), path, stage)
    with pytest.raises(ValueError, match="another batch"):
        tables.upsert_silver(observations(spark, BATCHES[1]), path, stage)
    tables.upsert_silver(observations(spark, BATCHES[1]), path, str(tmp_path / "own"), keep_stage=False)
    assert not (tmp_path / "own").exists() and len(silver(spark, path)) >= 3


def test_stream_follows_the_sidecars(spark, tmp_path, monkeypatch):
    """The path says one order, the sidecars the other; stream and batch agree. Only touched dates are read."""
    root, out, state = (str(tmp_path / n) for n in ("landing", "silver", "state"))
    schema = "source string, series string, ingest_date string, ingest_ts string, obs_date date, value double"
    plans = []
    merge = tables.latest_versions
    monkeypatch.setattr(tables, "latest_versions", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or merge(df))
    for ts, value in (("20250115T120000Z", 1.5), ("20250116T120000Z", 9.5)):
        row = [("daily", "FXUSDCAD", ts[:8], ts, dt.date(2025, 1, 10), value)]
        landing.write_landing(landing.build_payloads(spark.createDataFrame(row, schema)), root)
        late = "2025-01-20T00:00:00Z" if value == 1.5 else "2025-01-16T12:00:00Z"
        for meta in (tmp_path / "landing").rglob(landing.WRITTEN_SIDECARS):
            if f"ingest_ts={ts}" in str(meta):
                opener = gzip.open if meta.suffix == ".gz" else open
                with opener(meta, "rt") as file:
                    doc = json.loads(file.read())
                doc["retrieved_at_utc"] = late
                with opener(meta, "wt") as file:
                    file.write(json.dumps(doc))
                for crc in meta.parent.glob(f".{meta.name}.crc"):
                    crc.unlink()
        start_silver(spark, root, out, state, "r", payload_files=landing.WRITTEN_PAYLOADS, meta_files=landing.WRITTEN_SIDECARS).awaitTermination()
    batch = merge(landing.accepted(landing.scan(spark, root, "r", landing.WRITTEN_PAYLOADS, landing.WRITTEN_SIDECARS)))
    assert silver(spark, out) == [("FXUSDCAD", "2025-01-10", 1.5)] == [(r["series_id"], str(r["obs_date"]), r["value"]) for r in batch.collect()]
    assert "ds" in plans[-1].split("PartitionFilters: [")[1].split("]")[0] and "2025-01-10" in plans[-1] or "20098" in plans[-1]


def test_sorted_predictions_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("a", "2"), ("b", "1"), ("a", "1")], "series_id string, obs_date string")
    tables.write_predictions(df, str(tmp_path / "p"))
    files = sorted(f for f in (tmp_path / "p").iterdir() if f.suffix == ".parquet")
    order = [tuple(r) for f in files for r in spark.read.parquet(str(f)).select("obs_date", "series_id").collect()]
    assert order == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]
    tables.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["series_id", "obs_date"]


def test_file_facts(spark, tmp_path):
    (tmp_path / "model.bin").write_bytes(b"abc")
    row = tables.file_facts(spark, str(tmp_path)).first()
    assert (row["name"], row["sha256"], row["bytes"]) == ("model.bin", hashlib.sha256(b"abc").hexdigest(), 3)
