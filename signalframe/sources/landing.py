"""Landed raw payloads: scan, normalise, audit, write.

Layout: ``<root>/source=S/series=X/ingest_date=D/ingest_ts=T/`` with one gzipped JSON payload and one
JSON sidecar per directory. Spark skips names that begin with an underscore, so the sidecar must not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.functions import names
from signalframe.functions.numbers import as_number
from signalframe.schemas import PAYLOAD, PAYLOAD_META

PAYLOAD_FILES = "observations.json.gz"
META_FILES = "meta.json"
PARTITIONS = ["source", "series", "ingest_date", "ingest_ts"]


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def path_part(path: Column, key: str) -> Column:
    """Value of a ``key=value`` directory in a path."""
    return F.regexp_extract(path, f"/{key}=([^/]+)/", 1)


def ingest_time(text: Column) -> Column:
    """Ingest time of compact text such as ``20250115T120000Z`` (any suffix after it is ignored) or ISO text."""
    compact = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{8}T\d{6}Z)", 1), F.lit("yyyyMMdd'T'HHmmssX"))
    return F.coalesce(compact, text.try_cast("timestamp"))


def read_payloads(spark: SparkSession, root: str, payload_files: str = PAYLOAD_FILES) -> DataFrame:
    """One row per payload file. Filters on the partition columns prune directories."""
    return (
        spark.read.option("wholetext", True)
        .option("basePath", root)
        .option("pathGlobFilter", payload_files)
        .text(root)
        .select(
            F.col("value").alias("payload"),
            F.col("source").cast("string").alias("source"),
            F.col("series").cast("string").alias("series_id"),
            F.col("ingest_ts").cast("string").alias("ingest_ts"),
            F.col("_metadata.file_path").alias("raw_path"),
        )
    )


def read_sidecars(
    spark: SparkSession, root: str, meta_files: str = META_FILES, ingested: tuple[str, str] | None = None
) -> DataFrame:
    """One row per sidecar, with its directory.

    ``ingested`` gives the first and last ingest time of the directories to read, as their names
    have it; others are pruned. So are those that a filter on a partition column leaves out.
    """
    rows = (
        spark.read.schema(PAYLOAD_META)
        .option("multiLine", True)
        .option("basePath", root)
        .option("pathGlobFilter", meta_files)
        .json(root)
    )
    if ingested is not None:
        rows = rows.filter(F.col("ingest_ts").cast("string").between(*ingested))
    return rows.withColumn("_dir", directory(F.col("_metadata.file_path")))


def normalise(payloads: DataFrame, run_id: str, sidecars: DataFrame | None = None) -> DataFrame:
    """Payload rows to observations, good and bad, told apart by ``reject``.

    The value of an observation sits under the name of its series, bare or in a struct with ``v``.
    The ingest time is the sidecar's, else the directory's. ``reject`` is null for good rows, else
    ``payload`` (not JSON), ``date`` or ``value`` (missing, not a number, or zero).
    """
    if sidecars is not None:
        times = sidecars.select("_dir", F.col("retrieved_at_utc").alias("_retrieved"))
        payloads = payloads.withColumn("_dir", directory(F.col("raw_path"))).join(times, "_dir", "left")
    else:
        payloads = payloads.withColumn("_retrieved", F.lit(None).cast("string"))
    parsed = payloads.withColumn("_doc", F.from_json("payload", PAYLOAD)).withColumn(
        "_bad", F.col("_doc").isNull() | F.col("_doc.observations").isNull()
    )
    # A payload without a readable list keeps one row, to be rejected.
    rows = parsed.select(
        "*", F.explode(F.when(F.col("_bad"), F.array(F.lit(None).cast("map<string,string>"))).otherwise(F.col("_doc.observations"))).alias("_obs")
    )
    held = F.col("_obs")[F.col("series_id")]
    text = F.nullif(F.trim(F.coalesce(F.get_json_object(held, "$.v"), held)), F.lit(""))
    value = as_number(text)
    day = F.try_to_date(F.col("_obs")["d"], "yyyy-MM-dd")
    series = F.col("series_id")
    reject = (
        F.when(F.col("_bad"), "payload")
        .when(day.isNull(), "date")
        .when(value.isNull() | (value == 0) | F.isnan(value), "value")
    )
    return rows.select(
        day.alias("obs_date"),
        "series_id",
        value.alias("value"),
        names.base_currency(series).alias("base_currency"),
        names.quote_currency(series).alias("quote_currency"),
        "source",
        F.coalesce(ingest_time(F.col("_retrieved")), ingest_time(F.col("ingest_ts"))).alias("ingested_at"),
        F.lit(run_id).alias("run_id"),
        "raw_path",
        "ingest_ts",
        text.alias("raw_value"),
        reject.alias("reject"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject").isNull()).drop("reject", "raw_value", "ingest_ts")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject").isNotNull()).select("series_id", "raw_path", "obs_date", "raw_value", "reject")


def scan(
    spark: SparkSession, root: str, run_id: str, payload_files: str = PAYLOAD_FILES, meta_files: str | None = META_FILES
) -> DataFrame:
    """Payloads with their sidecars as observations; see ``normalise``."""
    sidecars = read_sidecars(spark, root, meta_files) if meta_files else None
    return normalise(read_payloads(spark, root, payload_files), run_id, sidecars)


def digest(content: Column) -> Column:
    """SHA-256 of text or bytes, in hex."""
    return F.sha2(content, 256)


def audit_files(spark: SparkSession, root: str, files: str = PAYLOAD_FILES) -> DataFrame:
    """Hash and size of every landed file as stored."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .load(root)
        .select("path", digest(F.col("content")).alias("sha256"), F.col("length").alias("stored_bytes"))
    )


def audit_payloads(payloads: DataFrame) -> DataFrame:
    """Hash, size, top-level keys and observation count of every payload as text."""
    text = F.col("payload")
    return payloads.select(
        "series_id",
        "raw_path",
        digest(text.cast("binary")).alias("sha256_raw"),
        F.octet_length(text).cast("long").alias("raw_bytes"),
        F.json_object_keys(text).alias("response_keys"),
        F.coalesce(F.size(F.from_json(text, PAYLOAD)["observations"]), F.lit(0)).alias("observations_count"),
    )


def build_payloads(observations: DataFrame) -> DataFrame:
    """Observations to one JSON payload per (source, series, ingest_date, ingest_ts).

    A payload is what one request returned: one series over its requested dates.
    """
    # The value key is the series itself, so the object is a map rather than a struct.
    one = F.to_json(
        F.map_from_arrays(
            F.array(F.lit("d"), F.col("series")),
            F.array(F.date_format("obs_date", "yyyy-MM-dd"), F.col("value").cast("string")),
        )
    )
    return (
        observations.select(*PARTITIONS, "obs_date", one.alias("_one"))
        .groupBy(*PARTITIONS)
        .agg(F.array_sort(F.collect_list(F.struct("obs_date", "_one"))).alias("_all"))
        .select(
            *PARTITIONS,
            F.concat(
                F.lit('{"observations":['),
                F.array_join(F.transform("_all", lambda r: r["_one"]), ","),
                F.lit("]}"),
            ).alias("value"),
            F.size("_all").alias("observations_count"),
        )
    )


def write_landing(payloads: DataFrame, root: str) -> None:
    """Write payloads and sidecars in the landing layout; one payload is one file.

    ``maxRecordsPerFile`` keeps payloads apart, the ingest time in the path keeps batches apart.
    """
    partitioned = payloads.repartition(*PARTITIONS).persist()
    (
        partitioned.select(*PARTITIONS, "value")
        .write.mode("append")
        .partitionBy(*PARTITIONS)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 1)
        .text(root)
    )
    sidecar = partitioned.select(
        *PARTITIONS,
        F.col("series").alias("series_id"),
        F.lit("json").alias("format"),
        F.date_format(ingest_time(F.col("ingest_ts")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("retrieved_at_utc"),
        digest(F.col("value").cast("binary")).alias("sha256_raw"),
        F.octet_length("value").cast("long").alias("raw_bytes"),
        F.json_object_keys("value").alias("response_keys"),
        F.col("observations_count").cast("long").alias("observations_count"),
    )
    sidecar.write.mode("append").partitionBy(*PARTITIONS).json(root)
    partitioned.unpersist()


# Names Spark gives the files of ``write_landing``.
WRITTEN_PAYLOADS = "part-*.txt.gz"
WRITTEN_SIDECARS = "part-*.json"
