"""Facts about an output, taken while it is written.

Counts, nulls, date ranges and checksums are observed in the write's own tasks and reach the driver with its results: the output
is not read again and its input is computed once. A task that is tried again counts once, as only its successful attempt reports.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from signalframe.sources.tables import COMPLETE, path_exists, read_marker, write_marker

#: Number of bits of a row's digest that a checksum adds up.
CHECK_BITS = 32


@dataclass(frozen=True)
class Facts:
    """What a written output holds."""

    path: str
    rows: int
    first_date: str | None
    last_date: str | None
    nulls: dict[str, int]
    checksum: int | None


def row_check(columns: list[str]) -> Column:
    """The first 32 bits of the MD5 of a row's values as text, joined by ``|``; null is empty. Adds up in any order and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, CHECK_BITS // 4), 16, 10).cast("long")


def observations(df: DataFrame, date: str | None, check: list[str]) -> list[Column]:
    """Aggregates over all rows: what ``Facts`` is made of."""
    out = [F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"null:{c}") for c in df.columns]]
    if date is not None:
        out += [F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date")]
    if check:
        out.append(F.sum(row_check(check)).alias("checksum"))
    return out


def write_observed(
    df: DataFrame, path: str, date: str | None = "obs_date", check: tuple[str, ...] = (), fmt: str = "parquet", partitions: tuple[str, ...] = (), **options
) -> Facts:
    """Write ``df`` to a new folder and say what was written, in one job.

    ``check``: columns of the checksum, by default none; text forms of floating numbers differ between engines, so keys serve best.
    An output without rows has no dates and no checksum, and zero nulls.
    """
    watched = Observation(uuid.uuid4().hex)
    seen = df.observe(watched, *observations(df, date if date in df.columns else None, list(check)))
    seen.write.format(fmt).options(**options).partitionBy(*partitions).save(path)
    got = watched.get
    nulls = {c: int(got[f"null:{c}"] or 0) for c in df.columns}
    return Facts(path, int(got["rows"]), got.get("first_date"), got.get("last_date"), nulls, got.get("checksum"))


def publish_observed(spark: SparkSession, outputs: dict[str, DataFrame], root: str, run_date: str, check: dict[str, tuple[str, ...]] | None = None) -> dict:
    """Write every output of a run with its facts and make it the latest one, all or nothing; returns the manifest.

    As ``tables.publish_run``, but empty outputs are found from the observed counts, and the run's ``manifest.json`` lists the facts.
    A failure before the pointer leaves readers on the run before.
    """
    folder = f"{root}/runs/run_date={run_date}/attempt={uuid.uuid4().hex[:12]}"
    facts = {}
    for name, df in outputs.items():
        facts[name] = write_observed(df, f"{folder}/{name}", check=(check or {}).get(name, ()))
        if not facts[name].rows:
            raise ValueError(f"output {name!r} of run {run_date} is empty")
        write_marker(spark, f"{folder}/{name}/{COMPLETE}", run_date)
    manifest = {"run_date": run_date, "folder": folder, "outputs": {n: asdict(f) for n, f in facts.items()}}
    write_marker(spark, f"{folder}/manifest.json", json.dumps(manifest))
    pointer = spark.range(1).select(F.lit(run_date).alias("run_date"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at"))
    pointer.write.mode("append").json(f"{root}/latest")
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a run's folder."""
    if not path_exists(spark, f"{folder}/manifest.json"):
        raise ValueError(f"{folder} has no manifest")
    return json.loads(read_marker(spark, f"{folder}/manifest.json"))


def fact_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    """The manifest as a table: one row per output and column."""
    rows = [
        (n, f["rows"], f["first_date"], f["last_date"], f["checksum"], c, k)
        for n, f in manifest["outputs"].items()
        for c, k in f["nulls"].items()
    ]
    return spark.createDataFrame(rows, "output string, rows long, first_date string, last_date string, checksum long, column string, nulls long")
