"""Helpers shared by the training-data operators.

Rows of ``documents`` are addressed by a *row key*: ``doc_id`` and the 64-bit hash of the text. Rows
that share both are repeats of one document and always get the same decision, so a decision can be
brought back to its rows by an ordinary join, whatever the partitioning of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.session import durable


#: What this worker process remembers between tasks, by name; one entry at most.
_STATE: dict[str, object] = {}


def worker_state(name: str, make: Callable[[], object]):
    """What a worker process keeps over its tasks: made once per ``name``, and let go when another name asks.

    Workers outlive operators; without the second rule each operator of a pipeline would add its memory.
    """
    if name not in _STATE:
        _STATE.clear()
        _STATE[name] = make()
    return _STATE[name]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_even_space(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``out``: the text with every run of white space replaced by one space; null becomes empty.

    Literal replacements cost a tenth of a regular expression, which is left to texts that still hold two
    spaces in a row. Two projections, so that the replacements are made once.
    """
    plain = F.coalesce(F.col(text_col), F.lit(""))
    for control in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(control), F.lit(" "))
    spaced = df.withColumn(out, plain)
    return spaced.withColumn(
        out, F.when(F.contains(F.col(out), F.lit("  ")), F.regexp_replace(out, " +", " ")).otherwise(F.col(out))
    )


def word_count(even: Column) -> Column:
    """Number of words in a text that went through ``with_even_space``: its spaces between other characters, and one."""
    spaces = F.octet_length(even) - F.octet_length(F.replace(even, F.lit(" "), F.lit("")))
    ends = F.startswith(even, F.lit(" ")).cast("int") + F.endswith(even, F.lit(" ")).cast("int")
    return F.when((even == "") | (even == " "), 0).otherwise(spaces + 1 - ends).cast("long")


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (columns ``_id``, ``_h``), one row for each key.

    Repeats of a kept row go: the semi join and the row number share one exchange on the key.
    """
    # All columns of a row travel as one, so that none clashes with the key.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), row_hash(F.col(text_col)).alias("_h"))
    left, right = keyed.alias("_l"), kept.select("_id", "_h").alias("_r")
    on = F.col("_l._id").eqNullSafe(F.col("_r._id")) & (F.col("_l._h") == F.col("_r._h"))
    one = Window.partitionBy(F.coalesce(F.col("_id"), F.lit(0)), F.col("_id").isNull(), "_h").orderBy("_h")
    return left.join(right, on, "left_semi").withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")


def running_total(df: DataFrame, keys: tuple[str, ...], order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, within ``keys`` in ``order``, without a group in one task.

    A global sort range-partitions on keys and order. Only a group that began in an earlier partition needs an offset,
    and a sorted partition continues at most one, so the offsets that are broadcast have at most one row per
    partition. The sorted rows are checkpointed: both uses see the same boundaries. Keys are not null.
    """
    placed = durable(df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    sums = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.sum("_sum").over(earlier)).filter("_before is not null").drop("_sum")
    here = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn(name, F.sum(value).over(here))
        .join(F.broadcast(offsets), [*keys, "_part"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_pos", "_part", "_before")
    )
