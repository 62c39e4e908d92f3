"""Versioned tables: commits, conflicts, crashes, comparison by digests, and gold that reads only what changed."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalframe.operators.features import gold_features
from signalframe.sources import versions
from signalframe.sources.versions import Conflict, VersionedTable, affected_months, refresh_gold

SCHEMA = "series_id string, obs_date date, value double"


def some(seed=1, series=("A", "B", "C"), days=420, share=0.6):
    """Series with gaps; the second has a whole quarter missing, the third two rows a month."""
    rng = random.Random(seed)
    out = []
    for n, s in enumerate(series):
        for k in range(days):
            day = dt.date(2022, 1, 1) + dt.timedelta(k)
            gone = (n == 1 and 100 <= k < 190) or (n == 2 and day.day not in (3, 17))
            if rng.random() < share and not gone:
                out.append((s, day, round(rng.uniform(1, 2), 4)))
    return out


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def rows(df):
    return sorted((r["series_id"], r["obs_date"], r["value"]) for r in df.select("series_id", "obs_date", "value").collect())


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_versions_stay_readable(spark, table):
    data = some()
    assert table.latest() is None
    with pytest.raises(ValueError):
        table.read()
    assert table.commit(frame(spark, data), None) == 1
    march = [r for r in data if (r[1].year, r[1].month) == (2022, 3)]
    changed = [(s, d, v + 1) for s, d, v in march if s == "A"]
    assert table.commit(frame(spark, changed), 1, [dt.date(2022, 3, 1)]) == 2
    assert rows(table.read(1)) == sorted(data)
    assert rows(table.read()) == sorted([r for r in data if r not in march] + changed)
    one, two = table.manifest(1)["months"], table.manifest(2)["months"]
    assert {m for m in one if one[m] != two.get(m)} == {"2022-03-01"}
    assert sum(e["rows"] for e in two.values()) == len(data) - len(march) + len(changed)
    assert rows(table.read(2, [dt.date(2022, 3, 1)])) == sorted(changed)
    assert all("2022-03-01" in f for f in table.read(2, [dt.date(2022, 3, 1)]).inputFiles())
    with pytest.raises(ValueError):
        table.commit(frame(spark, data), 2, [dt.date(2022, 3, 1)])  # rows outside
    assert table.commit(frame(spark, []), 2, [dt.date(2022, 3, 1)]) == 3
    assert "2022-03-01" not in table.manifest(3)["months"]


def test_of_two_writers_one_is_refused(spark, table, monkeypatch):
    table.commit(frame(spark, some()), None)
    new = frame(spark, [("A", dt.date(2022, 3, 1), 9.0)])
    assert table.commit(new, 1, [dt.date(2022, 3, 1)]) == 2
    with pytest.raises(Conflict):
        table.commit(new, 1, [dt.date(2022, 3, 1)])
    # Both saw the same version as the latest one, and only the creation of the manifest tells them apart.
    other = VersionedTable(spark, table.path)
    names = other._names()
    assert table.commit(new, 2, [dt.date(2022, 3, 1)]) == 3
    monkeypatch.setattr(other, "_names", lambda: names)
    with pytest.raises(Conflict):
        other.commit(new, 2, [dt.date(2022, 3, 1)])
    assert table.latest() == 3


def test_crashes_leave_the_version_before(spark, table, tmp_path, monkeypatch):
    data = some()
    table.commit(frame(spark, data), None)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_publish", crash)  # rows of some months are written, the manifest is not
    with pytest.raises(RuntimeError):
        table.commit(frame(spark, [("A", dt.date(2022, 3, 1), 9.0)]), 1, [dt.date(2022, 3, 1)])
    monkeypatch.undo()
    assert table.latest() == 1 and rows(table.read()) == sorted(data)
    # A writer that died while it wrote the manifest: its number is passed over.
    (tmp_path / "t" / "versions" / f"{2:09d}").write_text('{"schema": ')
    assert table.latest() == 1
    assert table.commit(frame(spark, [("A", dt.date(2022, 3, 1), 9.0)]), 1, [dt.date(2022, 3, 1)]) == 3
    assert table.latest() == 3 and ("A", dt.date(2022, 3, 1), 9.0) in rows(table.read())


def test_upsert_reads_and_writes_its_months_only(spark, table):
    stamped = lambda data, at: frame(spark, data).withColumns({"ingested_at": F.lit(at).cast("timestamp"), "raw_path": F.lit(at)})
    data = some()
    table.upsert(stamped(data, "2024-01-01"))
    old = [(s, d, 0.0) for s, d, _ in data[:5]]
    assert table.upsert(stamped(old, "2023-01-01")) == 2  # older versions lose
    assert table.changed_months(1, 2) == [] and table.changed(1, 2).count() == 0
    new = [("A", dt.date(2022, 5, 31), 7.0), ("D", dt.date(2023, 9, 9), 8.0)]
    assert table.upsert(stamped(new, "2025-01-01")) == 3
    want = {(s, d): v for s, d, v in data} | {(s, d): v for s, d, v in new}
    assert rows(table.read()) == sorted((s, d, v) for (s, d), v in want.items())
    assert table.changed_months(2, 3) == ["2022-05-01", "2023-09-01"]
    one, two = table.manifest(2)["months"], table.manifest(3)["months"]
    assert {m for m in two if two[m] != one.get(m)} == {"2022-05-01", "2023-09-01"}


def altered(data, seed):
    rng = random.Random(seed)
    out = {(s, d): v for s, d, v in data}
    for s, d, v in rng.sample(data, 3):
        out[s, d] = v + 1
    for s, d, _ in rng.sample(data, 2):
        out.pop((s, d), None)
    out["B", dt.date(2022, 5, 5)] = 1.5  # into the gap
    return [(s, d, v) for (s, d), v in out.items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_keys(spark, table, seed):
    a, b = some(), altered(some(), seed)
    table.commit(frame(spark, a), None)
    table.commit(frame(spark, b), 1)
    want = {(s, d) for s, d, _ in set(a) ^ set(b)}
    assert {tuple(r) for r in table.changed_keys(1, 2).collect()} == want
    assert {tuple(r) for r in table.changed(1, 2).collect()} == {(s, d.replace(day=1)) for s, d in want}
    # Equal months are not opened.
    files = table.digests(2, table.changed_months(1, 2)).inputFiles()
    assert {f.split("_month=")[1][:10] for f in files} <= {str(d.replace(day=1)) for _, d in want}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refreshed_gold_equals_a_full_recompute(spark, tmp_path, seed, monkeypatch):
    silver, gold = (VersionedTable(spark, str(tmp_path / n)) for n in ("silver", "gold"))
    silver.commit(frame(spark, some()), None)
    assert refresh_gold(silver, gold) == 1 and refresh_gold(silver, gold) == 1
    silver.commit(frame(spark, altered(some(), seed)), 1)
    read = []
    plain = VersionedTable.read
    monkeypatch.setattr(VersionedTable, "read", lambda self, version=None, months=None: read.append((self.path, months)) or plain(self, version, months))
    assert refresh_gold(silver, gold) == 2
    monkeypatch.undo()
    want = gold_features(silver.read())
    found = gold.read().select(*want.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert gold.manifest(2)["meta"] == {"silver": 2} and all(months is not None for _, months in read)


def test_untouched_months_are_not_scanned(spark, tmp_path):
    """A change in the middle of a long history: months far from it are in no scan and keep their files."""
    silver, gold = (VersionedTable(spark, str(tmp_path / n)) for n in ("silver", "gold"))
    data = some(days=1200, series=("A",), share=1.0)
    silver.commit(frame(spark, data), None)
    refresh_gold(silver, gold)
    silver.commit(frame(spark, [(s, d, v * 2 if d == dt.date(2023, 6, 15) else v) for s, d, v in data if (d.year, d.month) == (2023, 6)]), 1, [dt.date(2023, 6, 1)])
    seen = {}

    def compute(df):
        seen["months"] = {f.split("_month=")[1][:10] for f in df.inputFiles()}
        return gold_features(df)

    refresh_gold(silver, gold, compute)
    assert seen["months"] == {"2023-04-01", "2023-05-01", "2023-06-01", "2023-07-01", "2023-08-01"}
    one, two = gold.manifest(1)["months"], gold.manifest(2)["months"]
    assert {m for m in two if two[m]["attempt"] != one[m]["attempt"]} <= {"2023-05-01", "2023-06-01", "2023-07-01"}
    assert sorted(map(str, gold.read().collect())) == sorted(map(str, gold_features(silver.read()).select(*gold.read().columns).collect()))


def test_affected_months_by_brute_force(spark):
    rng = random.Random(3)
    counts = [(s, dt.date(2020 + k // 12, k % 12 + 1, 1), rng.choice([1, 2, 3, 9])) for s in "XY" for k in range(40) if rng.random() < 0.8]
    changed = [(s, m) for s, m, _ in counts if rng.random() < 0.06] + [("X", dt.date(2030, 1, 1))]
    back, ahead = 7, 2
    found = affected_months(spark.createDataFrame(counts, "series_id string, month date, rows long"), spark.createDataFrame(changed, "series_id string, month date"), back, ahead)
    got = {(r["series_id"], r["month"]): r["affected"] for r in found.collect()}
    for s in "XY":
        months = sorted({m for t, m, _ in counts if t == s} | {m for t, m in changed if t == s})
        held = {m: n for t, m, n in counts if t == s}
        line = [m for m in months for _ in range(held.get(m, 0))]
        first = {m: sum(held.get(x, 0) for x in months if x < m) for m in months}
        hit = set()
        for m in (m for t, m in changed if t == s):
            hit |= {m} | {line[k] for k in range(max(0, first[m] - ahead), min(len(line), first[m] + held.get(m, 0) + back))}
        need = set(hit)
        for m in hit:
            need |= {line[k] for k in range(max(0, first[m] - back), min(len(line), first[m] + held.get(m, 0) + ahead))}
        assert {m for (t, m), a in got.items() if t == s and a} == hit
        assert {m for (t, m) in got if t == s} >= need
