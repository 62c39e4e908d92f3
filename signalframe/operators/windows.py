"""Window specs and exact ways to split long or hot groups.

A daily series holds at most one row per calendar date (``keep_latest`` enforces it), so a window
over one series is bounded by the calendar: decades of history are a few thousand rows. Two
operators remove even that limit:

* ``in_chunks`` cuts each series into runs of fixed length, with the neighbouring rows a trailing
  or leading frame needs, so one long series is spread over many tasks;
* ``exact_rank`` numbers rows of groups of any size through a range-partitioned sort.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe.session import durable, ship_package, task_slots


def by_series(*extra: str) -> WindowSpec:
    return Window.partitionBy("series_id", *extra).orderBy("obs_date")


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    return spec.rowsBetween(-(rows - 1), 0)


def full_only(stat: Callable[[str], Column], name: str, frame: WindowSpec, minimum: int) -> Column:
    """``stat`` over ``frame``, null while fewer than ``minimum`` values are in it."""
    return F.when(F.count(name).over(frame) >= minimum, stat(name).over(frame))


def with_full_median(df: DataFrame, name: str, out: str, spec: WindowSpec, rows: int) -> DataFrame:
    """Median of the last ``rows`` values as ``out``, null while fewer are known.

    Sorting a collected frame is several times as fast as the ``percentile`` aggregate, which counts
    every value of every frame in a hash map. The result passes through a window of its own row:
    what a window returns is never evaluated again, while a plain expression would be copied into
    every later filter and projection that reads it.
    """
    a = F.col("_sorted")
    low, high = F.get(a, F.lit((rows - 1) // 2)), F.get(a, F.lit(rows // 2))
    return (
        df.withColumn("_frame", F.collect_list(name).over(trailing(spec, rows)))
        .withColumn("_sorted", F.when(F.size("_frame") >= rows, F.sort_array("_frame")))
        .withColumn("_median", low + (high - low) / 2)
        .withColumn(out, F.lag("_median", 0).over(spec))
        .drop("_frame", "_sorted", "_median")
    )


class MovingFrame:
    """The last ``rows`` values of a sequence, kept in order: each step adds one value and removes one.

    Null counts as a row without a value; NaN is larger than any number, as Spark sorts it.
    """

    def __init__(self, rows: int):
        self.rows, self.recent, self.ordered, self.nans = rows, deque(), [], 0

    def push(self, value: float | None) -> float | None:
        """Takes in the next value; the median, or null while fewer than ``rows`` values are known."""
        if len(self.recent) == self.rows:
            gone = self.recent.popleft()
            if gone is not None:
                if gone != gone:
                    self.nans -= 1
                else:
                    del self.ordered[bisect_left(self.ordered, gone)]
        self.recent.append(value)
        if value is not None:
            if value != value:
                self.nans += 1
            else:
                insort(self.ordered, value)
        if len(self.ordered) + self.nans < self.rows:
            return None
        low, high = (self.ordered[i] if i < len(self.ordered) else math.nan for i in ((self.rows - 1) // 2, self.rows // 2))
        return low + (high - low) / 2


def with_moving_median(df: DataFrame, name: str, out: str, spec: WindowSpec, rows: int) -> DataFrame:
    """``with_full_median`` with a moving order statistic: a row costs two searches in an ordered frame, not a sort of it.

    The rows leave the window in its order and pass through Python in Arrow batches, with the frame carried from batch to
    batch: there is no exchange or sort beyond the window's own, and a task holds ``rows`` values however long a series is.
    """
    ship_package(df.sparkSession)
    # Row 1 tells where a series begins. The window keeps each series in one partition and in order.
    placed = df.withColumn("_at", F.row_number().over(spec))
    given, at = placed.columns.index(name), placed.columns.index("_at")
    schema = T.StructType([*(f for f in placed.schema if f.name != "_at"), T.StructField(out, T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = MovingFrame(rows)
        for batch in batches:
            medians = []
            for place, value in zip(batch.column(at).to_pylist(), batch.column(given).to_pylist(), strict=True):
                if place == 1:
                    frame = MovingFrame(rows)
                medians.append(frame.push(value))
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(medians, pa.float64())], names=names)

    return placed.mapInArrow(run, schema)


def in_chunks(
    df: DataFrame,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int,
    rows: int = 4096,
) -> DataFrame:
    """``compute`` on runs of ``rows`` rows per series instead of on whole series.

    Each run also carries the ``back`` rows before it and the ``ahead`` rows after it, taken from
    its neighbours; those copies are dropped afterwards, so the result equals the plain window.
    Row positions come from counts per (series, year), which are aggregated map-side; a year of
    daily rows is the largest group any task sorts for them.
    """
    if back > rows or ahead > rows:
        raise ValueError("a run must be at least as long as its borrowed rows")
    year = F.year("obs_date")
    totals = df.groupBy("series_id", year.alias("_year")).agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.withColumn(
        "_start",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy("series_id").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).select("series_id", "_year", "_start")
    in_year = Window.partitionBy("series_id", "_year").orderBy("obs_date")
    placed = (
        df.withColumn("_year", year)
        .withColumn("_rn", F.row_number().over(in_year))
        .join(starts, ["series_id", "_year"])
        .withColumn("_pos", F.col("_start") + F.col("_rn") - 1)
        .drop("_year", "_start", "_rn")
    )
    own = F.floor(F.col("_pos") / rows)
    offset = F.col("_pos") % rows
    homes = F.array_compact(
        F.array(
            own,
            F.when(offset >= rows - back, own + 1),
            F.when((offset < ahead) & (own > 0), own - 1),
        )
    )
    spread = placed.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    return (
        compute(spread, by_series("_chunk"))
        .filter(F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunk", "_pos")
    )


def exact_rank(df: DataFrame, order: list[Column], keys: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Number rows 1, 2, ... within ``keys`` in ``order`` without putting a group into one task.

    A global sort range-partitions on (keys, order), so a hot key is cut between partitions. Only a
    group that began in an earlier partition needs an offset, and a sorted partition can continue
    at most one such group: the offsets have at most one row per partition, which is what makes
    broadcasting them safe whatever the data size. ``order`` should be total. The sorted rows are
    checkpointed, so both uses see the same partition boundaries.
    """
    keyed = [F.col(k) for k in keys]
    placed = durable(df.orderBy(*keyed, *order).withColumn("_pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_before", F.sum("_n").over(earlier))
        .filter(F.col("_before") > 0)
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_at"), "_before")
    )
    # Null-safe: rows with a null key are a group like any other.
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    local = (
        F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_pos"))
        if keys
        else F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    )
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(offsets), same, "left")
        .withColumn(name, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("long"))
        .drop("_pos", "_part", "_local", "_before", "_at", *[f"_key_{k}" for k in keys])
    )


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread_by: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join in which every key of ``big`` is spread over ``salts`` tasks, by default as many as a shuffle has.

    ``small`` is repeated once per salt. No broadcast is asked for: adaptive execution still
    chooses one when the measured size of ``small`` allows it.
    """
    salts = salts or task_slots(big.sparkSession)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def keep_latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the first in ``newest`` order.

    Spark plans ``row_number() = 1`` with a group limit below the exchange, so each task sends at
    most one row per key and a hot key costs no more than a cold one.
    """
    first = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def last_rows(df: DataFrame, rows: int, keys: tuple[str, ...] = ("series_id",), date: str = "obs_date") -> DataFrame:
    """The ``rows`` newest rows of each key, with ``recency`` 1 for the newest."""
    newest = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= rows)
