"""Subscriber tables from parquet or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: str, table: str | None = None, **options) -> DataFrame:
    """A parquet path, or a table of a ``jdbc:`` address.

    For large tables pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``,
    so that several tasks read it.
    """
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=table, **options).load()
    return spark.read.parquet(source if table is None else f"{source}/{table}.parquet")
