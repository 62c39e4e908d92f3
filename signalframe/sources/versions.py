"""Tables of dated series in versions, and what changed between two of them.

A version is one manifest: per month a folder, its rows, first and last date, and a digest. A commit writes folders of its own attempt and then
creates the next manifest, which fails if another writer has; nothing a reader may be reading is touched, and a crash leaves the
version before. Readers pin a version; old ones stay readable.

Digests form a tree: rows add up to (series, month), stored beside the rows, these to the month, in the manifest, and those to the table. Two
versions are compared from the top, so months with equal digests are never opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe.operators.features import GOLD_AHEAD, GOLD_BACK, gold_features
from signalframe.operators.incremental import latest_versions
from signalframe.sources.tables import path_exists, read_marker
from signalframe.session import durable

MONTH = "_month"
SUM = "decimal(38,0)"
DIGESTS = "series_id string, month date, rows long, first_date date, last_date date, d1 decimal(38,0), d2 decimal(38,0)"
_END = "end of manifest"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit builds on."""


def _month(date: str = "obs_date") -> Column:
    return F.trunc(date, "month")


def _sums(columns: list[str]) -> list[Column]:
    """Two independent checksums of rows, whatever their order."""
    named = sorted(columns)
    one, two = F.xxhash64(*named), F.xxhash64(F.lit(1), *named)
    return [F.sum(one.cast(SUM)).cast(SUM).alias("d1"), F.sum(two.cast(SUM)).cast(SUM).alias("d2")]


@dataclass
class VersionedTable:
    """A table with series_id and obs_date in versions under ``path``."""

    spark: SparkSession
    path: str

    # --- manifests

    def _names(self) -> list[int]:
        """Numbers of all manifests that were begun."""
        folder = f"{self.path}/versions"
        if not path_exists(self.spark, folder):
            return []
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def manifest(self, version: int) -> dict | None:
        """What a version holds; None for one whose writer did not finish."""
        text = read_marker(self.spark, f"{self.path}/versions/{version:09d}") or ""
        return json.loads(text[: -len(_END)]) if text.endswith(_END) else None

    def latest(self) -> int | None:
        for n in reversed(self._names()):
            if self.manifest(n) is not None:
                return n
        return None

    def _publish(self, parent: int | None, manifest: dict) -> int:
        names = self._names()
        if self.latest() != parent:
            raise Conflict(f"{self.path}: version {self.latest()} came after {parent}")
        version = (names[-1] if names else 0) + 1
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{version:09d}")
        try:
            out = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{self.path}: version {version} was taken by another writer") from error
            raise
        out.write(bytearray((json.dumps(manifest) + _END).encode()))
        out.close()
        return version

    # --- writing

    def commit(self, rows: DataFrame, parent: int | None, months: list | None = None, meta: dict | None = None) -> int:
        """A new version after ``parent``: ``rows`` instead of its ``months``, all other months as they were.

        ``months`` None replaces all. Months without rows are gone. Every row must lie in ``months``. Raises ``Conflict``
        if ``parent`` is not the latest version any more; the caller then reads again. The driver holds one entry per month.
        """
        attempt = f"{self.path}/data/{uuid.uuid4().hex}"
        before = (self.manifest(parent) or {}) if parent is not None else {}
        if before and months is not None:
            names = T.StructType.fromJson(before["schema"]).names
            rows = rows.select(*names) if set(names) == set(rows.columns) else rows
        columns = rows.columns
        placed = rows.withColumn(MONTH, _month())
        placed.repartitionByRange(MONTH, "series_id", "obs_date").sortWithinPartitions(MONTH, "series_id", "obs_date").write.partitionBy(MONTH).parquet(f"{attempt}/rows")
        # Read back with the types that were written; an empty commit has no folder to infer from.
        written = self.spark.read.schema(placed.schema).parquet(f"{attempt}/rows")
        ends = [F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date")]
        each = written.groupBy("series_id", F.col(MONTH).alias("month")).agg(F.count(F.lit(1)).alias("rows"), *ends, *_sums(columns))
        each.select(*[f.name for f in T._parse_datatype_string(DIGESTS).fields], F.col("month").alias(MONTH)).repartitionByRange(MONTH).write.partitionBy(MONTH).parquet(f"{attempt}/digests")
        tree = self.spark.read.schema(f"{DIGESTS}, {MONTH} date").parquet(f"{attempt}/digests")
        top = tree.groupBy(MONTH).agg(F.sum("rows").alias("rows"), F.min("first_date").alias("first"), F.max("last_date").alias("last"), *[F.sum(d).cast(SUM).alias(d) for d in ("d1", "d2")])
        made = {
            str(r[MONTH]): {"attempt": attempt.rsplit("/", 1)[1], "rows": r["rows"], "first": str(r["first"]), "last": str(r["last"]), "digest": f"{r['d1']}:{r['d2']}"}
            for r in top.collect()
        }
        replaced = {str(m) for m in months} if months is not None else None
        if replaced is not None and set(made) - replaced:
            raise ValueError(f"rows outside the months to replace: {sorted(set(made) - replaced)}")
        kept = {m: e for m, e in before.get("months", {}).items() if replaced is not None and m not in replaced}
        schema = json.loads(rows.schema.json())
        if kept and before["schema"] != schema:
            if T.StructType.fromJson(before["schema"]).simpleString() != rows.schema.simpleString():
                raise ValueError(f"columns differ from version {parent}: {rows.schema.simpleString()}")
        return self._publish(parent, {"schema": schema, "months": kept | made, "meta": meta or {}})

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame] = latest_versions) -> int:
        """A new version in which ``merge`` settled ``batch`` with the rows of its months; all other months are neither read nor written."""
        parent = self.latest()
        batch = durable(batch)
        months = [r[0] for r in batch.select(_month()).distinct().collect()]
        rows = batch
        if parent is not None:
            rows = self.read(parent, months).unionByName(batch.select(*self._schema(parent).names))
        return self.commit(merge(rows), parent, months)

    # --- reading

    def _held(self, version: int | None) -> dict:
        version = self.latest() if version is None else version
        held = self.manifest(version) if version is not None else None
        if held is None:
            raise ValueError(f"{self.path} has no version {version}")
        return held

    def _schema(self, version: int | None) -> T.StructType:
        return T.StructType.fromJson(self._held(version)["schema"])

    def _folders(self, version: int | None, months: list | None, kind: str) -> list[str]:
        wanted = None if months is None else {str(m) for m in months}
        entries = self._held(version)["months"].items()
        return [f"{self.path}/data/{e['attempt']}/{kind}/{MONTH}={m}" for m, e in sorted(entries) if wanted is None or m in wanted]

    def _frame(self, folders: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, months: list | None = None) -> DataFrame:
        """Rows of a version, by default the latest at this moment, or of some of its months; other months' files are not listed."""
        version = self.latest() if version is None else version
        return self._frame(self._folders(version, months, "rows"), self._schema(version))

    def digests(self, version: int | None = None, months: list | None = None) -> DataFrame:
        """series_id, month, rows, first_date, last_date, d1, d2 of a version or some of its months: a row per (series, month)."""
        return self._frame(self._folders(version, months, "digests"), T._parse_datatype_string(DIGESTS))

    def changed_months(self, old: int, new: int) -> list[str]:
        """Months whose digests differ, from the manifests alone."""
        a, b = self._held(old)["months"], self._held(new)["months"]
        return sorted(m for m in a.keys() | b.keys() if a.get(m, {}).get("digest") != b.get(m, {}).get("digest"))

    def changed(self, old: int, new: int) -> DataFrame:
        """series_id and month of every (series, month) that differs; only the digests of differing months are read."""
        months = self.changed_months(old, new)
        keys = ["series_id", "month", "d1", "d2"]
        both = self.digests(old, months).select(*keys, F.lit(-1).alias("side")).unionByName(self.digests(new, months).select(*keys, F.lit(1).alias("side")))
        same = both.groupBy("series_id", "month", "d1", "d2").agg(F.sum("side").alias("side")).filter("side != 0")
        return same.select("series_id", "month").distinct()

    def changed_keys(self, old: int, new: int) -> DataFrame:
        """series_id and obs_date of the rows that came, went or differ; only rows of differing months are read."""
        months, pairs = self.changed_months(old, new), durable(self.changed(old, new))
        names = sorted(self._schema(new).names)

        def side(version: int, mark: int) -> DataFrame:
            rows = self.read(version, months).withColumn(MONTH, _month())
            rows = rows.join(pairs.withColumnRenamed("month", MONTH), ["series_id", MONTH], "left_semi")
            return rows.select("series_id", "obs_date", F.xxhash64(*names).alias("d1"), F.xxhash64(F.lit(1), *names).alias("d2"), F.lit(mark).alias("side"))

        both = side(old, -1).unionByName(side(new, 1))
        same = both.groupBy("series_id", "obs_date", "d1", "d2").agg(F.sum("side").alias("side")).filter("side != 0")
        return same.select("series_id", "obs_date").distinct()


def affected_months(counts: DataFrame, changed: DataFrame, back: int, ahead: int) -> DataFrame:
    """series_id, month, affected: the months whose rows are to be recomputed (affected) and those that are read for it.

    ``counts`` has the rows of every (series, month), ``changed`` the pairs that changed. A row reads ``back`` rows before it and ``ahead`` after it;
    how many months that is follows from the counts, so gaps and thin months are right. Only these counts are windowed, no rows.
    """
    marked = counts.select("series_id", "month", "rows").join(changed.withColumn("_hit", F.lit(True)), ["series_id", "month"], "full")
    order = Window.partitionBy("series_id").orderBy("month")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    placed = marked.withColumn("_end", F.sum(F.coalesce("rows", F.lit(0))).over(upto)).withColumn("_start", F.col("_end") - F.coalesce("rows", F.lit(0)))

    def near(hit: Column, behind: int, before: int) -> Column:
        """Does the month meet rows from ``before`` rows ahead of a month that was hit to ``behind`` rows behind it."""
        last = F.max(F.when(hit, F.col("_end"))).over(upto)
        first = F.min(F.when(hit, F.col("_start"))).over(after)
        return F.coalesce(F.col("_start") < last + behind, F.lit(False)) | F.coalesce(first - before < F.col("_end"), F.lit(False)) | hit

    hit = F.coalesce("_hit", F.lit(False))
    found = placed.withColumn("affected", near(hit, back, ahead)).withColumn("_needed", near(F.col("affected"), ahead, back))
    return found.filter("_needed").select("series_id", "month", "affected")


def refresh_gold(
    silver: VersionedTable, gold: VersionedTable, compute: Callable[[DataFrame], DataFrame] = gold_features, back: int = GOLD_BACK, ahead: int = GOLD_AHEAD
) -> int:
    """Bring ``gold`` in step with the latest version of ``silver``; returns gold's version.

    Gold's manifest says which silver version it was made from. What changed since is found from digests; only the months that a change
    reaches are read from silver, with the neighbouring months that their rows look back to, and only the months it
    reaches are written. Equals computing everything anew. ``compute`` may look ``back`` rows back and ``ahead`` rows ahead within a series.
    """
    new, parent = silver.latest(), gold.latest()
    if parent is None:
        return gold.commit(compute(silver.read(new)), None, None, {"silver": new})
    old = gold.manifest(parent)["meta"]["silver"]
    if old == new:
        return parent
    parts = durable(affected_months(silver.digests(new), silver.changed(old, new), back, ahead))
    read = [r[0] for r in parts.select("month").distinct().collect()]
    write = [r[0] for r in parts.filter("affected").select("month").distinct().collect()]
    # Under a name of its own: tables may have a column ``month``.
    parts = parts.withColumnRenamed("month", MONTH)
    pairs = ["series_id", MONTH]
    own = parts.filter("affected").select(*pairs)
    needed = silver.read(new, read).withColumn(MONTH, _month()).join(parts.select(*pairs), pairs, "left_semi").drop(MONTH)
    fresh = compute(needed).withColumn(MONTH, _month()).join(own, pairs, "left_semi")
    kept = gold.read(parent, write).withColumn(MONTH, _month()).join(own, pairs, "left_anti")
    return gold.commit(kept.unionByName(fresh).drop(MONTH), parent, write, {"silver": new})
