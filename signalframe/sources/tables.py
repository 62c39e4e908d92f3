"""Partitioned tables, multi-file scans and run outputs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.functions import names
from signalframe.operators.incremental import latest_versions
from signalframe.sources.landing import digest

SILVER_PARTITIONS = ["ds"]
GRAINS = ("day", "month")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Written by this library when a folder is whole; not every committer leaves a marker of its own.
COMPLETE = "_complete"


def write_marker(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_marker(spark: SparkSession, path: str) -> str | None:
    if not path_exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    source = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    text = jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return text


def is_complete(spark: SparkSession, path: str) -> bool:
    """Did the job that wrote a folder finish."""
    return path_exists(spark, os.path.join(path, COMPLETE))


def overwrite_partitions(df: DataFrame, path: str, partitions: list[str], fmt: str = "parquet", **options) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**options)
        .partitionBy(*partitions)
        .save(path)
    )


# --- silver ----------------------------------------------------------------------------------


def batch_mark(batch: DataFrame) -> str:
    """Number and checksum of a batch's observations, whatever run brings them."""
    named = [c for c in ("series_id", "obs_date", "value", "ingested_at", "raw_path") if c in batch.columns]
    n, total = batch.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*named).cast("decimal(20,0)"))).first()
    return f"{n}:{total}"


def upsert_silver(
    batch: DataFrame,
    path: str,
    stage: str,
    partitions: list[str] | None = None,
    grain: str = "day",
    keep_stage: bool = True,
) -> None:
    """Merge a batch of observations into the silver table; the newest version of a key wins.

    Only the date partitions the batch touches are read and rewritten: the batch is written to
    ``stage`` first, and its dates (one per calendar date at most) become an explicit filter on the
    partition column. The merged rows are staged too; a repeated call with the same finished stage
    only publishes it again. So a crash while partitions are being replaced is repaired by a replay,
    and nothing already replaced is read back. A stage remembers its batch: another batch on a
    finished stage is an error, never a silent loss.

    Without ``keep_stage`` the staged rows go once they are published; a replay must then bring a new stage.

    ``ds`` is the date, or its month with ``grain="month"``, which suits few series with long
    histories. By default a folder holds all series of its ``ds``, in files of useful size;
    ``["source", "series_id", "ds"]`` gives a folder per series and date.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    spark = batch.sparkSession
    partitions = partitions or SILVER_PARTITIONS
    held = read_marker(spark, f"{stage}/{COMPLETE}")
    if held is None:
        dated = batch.withColumn("ds", F.trunc("obs_date", "month") if grain == "month" else F.col("obs_date"))
        dated.write.mode("overwrite").parquet(f"{stage}/batch")
        rows = spark.read.parquet(f"{stage}/batch")
        mark = batch_mark(rows)
        if path_exists(spark, path):
            touched = [r[0] for r in rows.select("ds").distinct().collect()]
            old = spark.read.parquet(path).filter(F.col("ds").isin(touched))
            rows = old.unionByName(rows, allowMissingColumns=True)
        latest_versions(rows).write.mode("overwrite").parquet(f"{stage}/merged")
        write_marker(spark, f"{stage}/{COMPLETE}", mark)
        remove_path(spark, f"{stage}/batch")
    elif held != batch_mark(batch):
        raise ValueError(f"stage {stage!r} holds another batch: give each batch a stage of its own")
    order = list(dict.fromkeys([*partitions, "series_id", "obs_date"]))
    # By range, so that a date is in as few files as its size asks for and a large one in several.
    overwrite_partitions(spark.read.parquet(f"{stage}/merged").repartitionByRange(*order), path, partitions)
    if not keep_stage:
        remove_path(spark, stage)


def read_silver(spark: SparkSession, path: str, since: str | None = None, dates: list[str] | None = None) -> DataFrame:
    """Silver rows after a date, or of given dates.

    Each filter is also put on the partition column, in a form that holds for either grain, so
    folders outside it are not read.
    """
    df = spark.read.parquet(path)
    if since is not None:
        day = F.lit(since).cast("date")
        df = df.filter((F.col("ds") >= F.trunc(day, "month")) & (F.col("obs_date") > day))
    if dates is not None:
        days = [F.lit(d).cast("date") for d in dates]
        folders = days + [F.trunc(d, "month") for d in days]
        df = df.filter(F.col("ds").isin(folders) & F.col("obs_date").isin(days))
    return df.drop("ds")


# --- gold ------------------------------------------------------------------------------------


def write_gold(gold: DataFrame, path: str) -> None:
    """Replace the given series, leave the others."""
    rows = gold.withColumn("series", F.col("series_id"))
    order = ["series", "obs_date"]
    overwrite_partitions(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, ["series"])


def read_gold(spark: SparkSession, path: str, series: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if series is not None:
        df = df.filter(F.col("series").isin(series))
    return df.drop("series")


def series_of_path(path: Column) -> Column:
    """Series id of a file: a ``series=`` folder, else a folder that looks like an id, else the parent."""
    hive = F.regexp_extract(path, r"/series=([^/]+)/", 1)
    folder = F.regexp_extract(path, rf"/({names.SERIES_PREFIX}[^/]{{4,}})/", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.coalesce(F.nullif(hive, F.lit("")), F.nullif(folder, F.lit("")), parent)


def _named_gold_rows(spark: SparkSession, root: str, files: str) -> DataFrame:
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .option("mergeSchema", True)
        .option("ignoreCorruptFiles", True)
        .parquet(root)
    )
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    given = F.col("series_id") if "series_id" in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("series_id", F.coalesce(given, series_of_path(F.col("_file"))))


def _mixed_files(named: DataFrame) -> DataFrame:
    """Files that hold several series. One aggregated row per file; reads only ``series_id``."""
    return (
        named.groupBy("_file")
        .agg(F.min("series_id").alias("_lo"), F.max("series_id").alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select("_file")
    )


def scan_gold_files(spark: SparkSession, root: str, files: str = "*.parquet") -> DataFrame:
    """All gold files below ``root``, whatever their layout.

    A file without ``series_id`` gets it from its path. A file that holds several series is left
    out whole and an unreadable one is skipped; ``gold_file_rejects`` tells which and why.
    """
    named = _named_gold_rows(spark, root, files)
    return named.join(_mixed_files(named), "_file", "left_anti").drop("_file")


def gold_file_rejects(spark: SparkSession, root: str, files: str = "*.parquet") -> DataFrame:
    """Files that ``scan_gold_files`` leaves out: file, reason (``mixed``, or ``no rows`` when nothing can be read)."""
    named = _named_gold_rows(spark, root, files).select("_file", "series_id")
    every = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .load(root)
        .select(F.col("_metadata.file_path").alias("_file"))
    )
    unread = every.join(named.select("_file").distinct(), "_file", "left_anti").withColumn("reason", F.lit("no rows"))
    mixed = _mixed_files(named).withColumn("reason", F.lit("mixed"))
    return mixed.unionByName(unread).withColumnRenamed("_file", "file")


# --- outputs ---------------------------------------------------------------------------------


def write_sorted(df: DataFrame, path: str, order: list[str], fmt: str = "parquet", **options) -> None:
    """Files whose concatenation is in ``order``: range partitions, each sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").format(fmt).options(
        **options
    ).save(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    write_sorted(preds, path, ["obs_date", "series_id"])


def write_metrics(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_latest(documents: DataFrame, rows: DataFrame, path: str) -> None:
    """Per pair, the nested document as JSON and its rows as CSV, under ``json/`` and ``csv/``."""
    overwrite_partitions(documents.withColumn("pair_dir", names.slug(F.col("pair"))), f"{path}/json", ["pair_dir"], "json")
    overwrite_partitions(
        rows.drop("series_id", "row_no").withColumn("pair_dir", names.slug(F.col("pair"))),
        f"{path}/csv",
        ["pair_dir"],
        "csv",
        header=True,
    )


def publish_run(spark: SparkSession, outputs: dict[str, DataFrame], root: str, run_date: str) -> str:
    """Write every output of a run and make it the latest one, all or nothing.

    Outputs go to ``<root>/runs/run_date=D/attempt=<id>/<name>``, a new folder for each attempt. When
    all are complete and none is empty, one pointer row is added below ``<root>/latest``; readers
    follow the newest. A failure before that leaves every reader on the run before, also when
    the same date is run again.
    """
    folder = f"{root}/runs/run_date={run_date}/attempt={uuid.uuid4().hex[:12]}"
    for name, df in outputs.items():
        df.write.parquet(f"{folder}/{name}")
        write_marker(spark, f"{folder}/{name}/{COMPLETE}", run_date)
    for name in outputs:
        written = f"{folder}/{name}"
        if not is_complete(spark, written) or spark.read.parquet(written).isEmpty():
            raise ValueError(f"output {name!r} of run {run_date} is missing or empty")
    pointer = spark.range(1).select(
        F.lit(run_date).alias("run_date"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at")
    )
    pointer.write.mode("append").json(f"{root}/latest")
    return folder


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An output of the latest published run."""
    pointers = spark.read.schema("run_date string, folder string, published_at timestamp").json(f"{root}/latest")
    newest = pointers.orderBy(F.desc("published_at"), F.desc("run_date")).first()
    if newest is None:
        raise ValueError(f"nothing published below {root}")
    return spark.read.parquet(f"{newest['folder']}/{name}")


def file_facts(spark: SparkSession, root: str, files: str = "*") -> DataFrame:
    """Name, path, hash and size of files, for manifests."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .load(root)
    )
    return found.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        "path",
        digest(F.col("content")).alias("sha256"),
        F.col("length").alias("bytes"),
    )
