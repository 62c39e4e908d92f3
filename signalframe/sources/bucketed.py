"""Tables kept apart by series, so that windows and joins on (series, date) need no exchange.

A table is written once with one file per bucket, sorted by series and date. Tables of equally many buckets are
co-partitioned: what one task reads of one of them meets only what it reads of the others. A series has at most one row per
calendar date, so a bucket is as large as its share of the series; ``buckets`` is to be chosen so that it fits a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from signalframe.session import task_slots

KEY, ORDER = "series_id", ("series_id", "obs_date")

SETTINGS = {
    # Equal (series, date) lie in equal buckets when the series alone decides the bucket.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The order of a bucket's only file is the order of its rows.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # Sides that already lie together are not to be sent around, however small.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
KEPT = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.checkpoint.dir")


def co_partitioned_session(spark: SparkSession) -> SparkSession:
    """A session of the same application and catalog whose plans make use of the buckets; ``spark`` itself is left as it is."""
    session = spark.newSession()
    for name in KEPT:
        value = spark.conf.get(name, None)
        if value is not None and session.conf.get(name, None) != value and session.conf.isModifiable(name):
            session.conf.set(name, value)
    for name, value in SETTINGS.items():
        session.conf.set(name, value)
    return session


def write_bucketed(df: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write ``df`` to the new folder ``path``, one sorted file per bucket; the number of buckets.

    Rows with a null series share one bucket. The registration made while writing is dropped; the files stay.
    """
    buckets = buckets or task_slots(df.sparkSession)
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, KEY).write.format("parquet").mode("errorifexists").option("path", path)
    writer.bucketBy(buckets, KEY).sortBy(*ORDER).saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")
    return buckets


def read_bucketed(session: SparkSession, path: str, buckets: int, schema: T.StructType | None = None) -> DataFrame:
    """A table of ``write_bucketed``, also one that another application wrote: the folder is registered under a new name.

    ``schema`` spares looking into a file. ``buckets`` must be the number it was written with.
    """
    schema = schema or session.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    session.sql(
        f"create table {name} ({columns}) using parquet clustered by ({KEY}) sorted by ({', '.join(ORDER)}) "
        f"into {int(buckets)} buckets location '{path}'"
    )
    return session.table(name)
