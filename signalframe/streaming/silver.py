"""Landed payloads to the silver table as an incremental file stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalframe.sources import landing
from signalframe.sources.tables import read_marker, remove_path, upsert_silver


def payload_stream(
    spark: SparkSession, root: str, payload_files: str = landing.PAYLOAD_FILES, files_per_trigger: int | None = None
) -> DataFrame:
    """Payload files as they arrive; series and ingest time are read from the path.

    The checkpoint remembers which files were taken, which is the ingest watermark: a file that
    arrives late by name is still taken, once.
    """
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", payload_files)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = F.col("_metadata.file_path")
    return reader.load(root).select(
        F.col("value").alias("payload"),
        landing.path_part(path, "source").alias("source"),
        landing.path_part(path, "series").alias("series_id"),
        landing.path_part(path, "ingest_ts").alias("ingest_ts"),
        path.alias("raw_path"),
    )


def start_silver(
    spark: SparkSession,
    root: str,
    silver: str,
    state: str,
    run_id: str,
    rejects: str | None = None,
    payload_files: str = landing.PAYLOAD_FILES,
    files_per_trigger: int | None = None,
    grain: str = "day",
    meta_files: str = landing.META_FILES,
) -> StreamingQuery:
    """Take the files that are new, merge them into ``silver``, stop.

    ``state`` holds the stream checkpoint and the staged merges. Bad rows go to ``rejects``, one
    folder per batch, so a replayed batch replaces its own rejects. Ingest times are the sidecars',
    as in a batch scan; only sidecars of the batch's range of ingest directories are read.

    A stage is named by the stream's own id and the batch number: a rebuilt checkpoint counts from 0
    again, but under a new id.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(read_marker(spark, f"{state}/checkpoint/metadata"))["id"]
        stages = f"{state}/stage/{stream}"
        first, last = batch.agg(F.min("ingest_ts"), F.max("ingest_ts")).first()
        sidecars = landing.read_sidecars(spark, root, meta_files, (first, last)) if first is not None else None
        rows = landing.normalise(batch, run_id, sidecars).persist()
        upsert_silver(landing.accepted(rows), silver, f"{stages}/batch={batch_id}", grain=grain)
        # The batch before is committed once this one runs; its stage will not be asked for again.
        remove_path(spark, f"{stages}/batch={batch_id - 1}")
        if rejects:
            landing.rejected(rows).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        rows.unpersist()

    return (
        payload_stream(spark, root, payload_files, files_per_trigger)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
