"""Keyed state machines on streams, fed in event-time order.

Rows of a stream come in any order. A row waits in its key's state until the watermark has passed its time, as an earlier one may still
come; then the machine takes it. What a machine does at a time of its own (a window's end, a token's expiry) happens
between the rows at that time, whichever batch brings them. So the rows that come out depend on the input alone, not on how it was cut into batches.

Every call of a Python worker to the state store costs a fraction of a millisecond, however little it moves. ``Pools`` therefore holds the keys of one
hash value together: what a batch brings for a pool is added to its state in one call, and is read back when the watermark has passed some of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from signalframe.functions import dates
from signalframe.session import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HELD = "times array<long>, ties array<long>, bodies array<string>, timer long, state string"
_Out = Row("key", "part", "us", "tie", "body")
_OUT = "key long, part long, us long, tie long, body string"
#: Pools of keys, fixed when a stream starts, and rows in one entry of a pool's list at most.
POOLS, ENTRY = 2048, 10_000
NO_KEY = -1
_WAITING = "keys array<long>, parts array<long>, times array<long>, ties array<long>, bodies array<string>"
_STATES = "keys array<long>, parts array<long>, states array<string>"


def _place(row: tuple[int, int | None, str]) -> tuple:
    """Order of rows: by time and tiebreak, a null one first."""
    us, tie, body = row
    return us, tie is not None, tie or 0, body


class InEventOrder(StatefulProcessor):
    """Base of a machine. Times of rows are microseconds, own times milliseconds; ``state`` is plain JSON data or None.

    State of a key without waiting rows, own time and ``state`` is removed.
    """

    def apply(self, key: tuple, state, us: int, tie: int, body: str) -> tuple[object, list[str]]:
        """The new state, and what to put out."""
        raise NotImplementedError

    def due(self, key: tuple, state) -> int | None:
        """When ``expire`` is to be called, if at all."""
        return None

    def expire(self, key: tuple, state, at: int) -> tuple[object, list[str]]:
        return state, []

    def taken(self, key: tuple, state, waiting: list[tuple], now: int) -> tuple[object, int, list[tuple], int | None]:
        """Take the rows of one key, in order, that the watermark has passed, and its own times between them.

        The new state, how many rows were taken, (us, tie, output) in order and the next own time.
        """
        out, ready = [], 0
        for us, tie, body in waiting:
            if us > now * 1000:
                break
            while (at := self.due(key, state)) is not None and at * 1000 <= us:
                state, made = self.expire(key, state, at)
                out += [(at * 1000, None, o) for o in made]
            state, made = self.apply(key, state, us, tie, body)
            out += [(us, tie, o) for o in made]
            ready += 1
        while (at := self.due(key, state)) is not None and at <= now:
            state, made = self.expire(key, state, at)
            out += [(at * 1000, None, o) for o in made]
        return state, ready, out, at

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [(r["_us"], r["_tie"], r["_body"]) for r in rows], timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues, True)

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, new: list[tuple[int, int, str]], timers, fired: bool) -> Iterator[Row]:
        now = max(timers.getCurrentWatermarkInMs(), 0)
        waiting, timer, state = new, None, None
        if self.held.exists():
            times, ties, bodies, timer, text = self.held.get()
            waiting = [*zip(times, ties, bodies), *new]
            state = json.loads(text)
        waiting.sort(key=_place)
        state, ready, out, at = self.taken(key, state, waiting, now)
        yield from (_Out(*key, *o) for o in out)
        waiting = waiting[ready:]
        # Awake when all that wait are ready, or at the machine's own time.
        wanted = [-(-waiting[-1][0] // 1000)] if waiting else []
        wanted += [at] if at is not None else []
        wake = max(min(wanted), now + 1) if wanted else None
        if timer is not None and timer != wake and not fired:
            self.handle.deleteTimer(timer)
        if wake is None and state is None:
            self.held.clear()
            return
        if wake is not None and (wake != timer or fired):
            self.handle.registerTimer(wake)
        self.held.update(([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], wake, json.dumps(state)))


class Pools(StatefulProcessor):
    """``machine`` for all keys of a pool. Input and output are frames; pool ``NO_KEY`` gets the rows that only move the watermark.

    Rows wait in a list that batches add to; the states of a pool's keys are one value. Both are read and written anew only when a row is ready
    or a machine's own time has come. Keys without waiting rows, own time and state are forgotten, and so are pools.
    """

    def __init__(self, machine: InEventOrder):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.states = handle.getValueState("states", _STATES)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entries = []
        for frame in rows:
            if key[0] == NO_KEY:
                continue
            ties = [None if missing else tie for tie, missing in zip(frame["tie"].tolist(), frame["untied"].tolist())]
            entries.append((frame["key"].tolist(), frame["part"].tolist(), frame["us"].tolist(), ties, frame["body"].tolist()))
        if entries:
            yield from self._add(entries, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], max(timerValues.getCurrentWatermarkInMs(), 0), self._timer(), True)

    def close(self) -> None:
        pass

    def _timer(self) -> int | None:
        found = self.timer.get()
        return None if found is None else found[0]

    def _add(self, entries: list[tuple], timers) -> Iterator[pd.DataFrame]:
        now, timer = max(timers.getCurrentWatermarkInMs(), 0), self._timer()
        first = min(min(times) for _, _, times, _, _ in entries)
        if first <= now * 1000 or (timer is not None and timer <= now):
            yield from self._advance(entries, now, timer, False)
            return
        self.waiting.appendList(entries)
        self._wake(timer, -(-first // 1000) if timer is None else min(timer, -(-first // 1000)), False)

    def _wake(self, timer: int | None, wake: int | None, fired: bool) -> None:
        if timer is not None and timer != wake and not fired:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.timer.clear()
        elif wake != timer or fired:
            self.handle.registerTimer(wake)
            self.timer.update((wake,))

    def _advance(self, entries: list[tuple], now: int, timer: int | None, fired: bool) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, list] = {}
        for keys, parts, times, ties, bodies in [*self.waiting.get(), *entries]:
            for k, p, us, tie, body in zip(keys, parts, times, ties, bodies):
                waiting.setdefault((k, p), []).append((us, tie, body))
        states = {(k, p): json.loads(text) for k, p, text in zip(*(self.states.get() or ((), (), ())))}
        made, rest, kept, wanted = [], [], [], []
        for key in {**states, **waiting}:
            rows = waiting.get(key, [])
            if len(rows) > 1:
                rows.sort(key=_place)
            state, ready, out, at = self.machine.taken(key, states.get(key), rows, now)
            made += [(*key, *o) for o in out]
            rest += [(*key, *row) for row in rows[ready:]]
            wanted += [-(-row[0] // 1000) for row in rows[ready : ready + 1]] + ([at] if at is not None else [])
            if state is not None:
                kept.append((*key, json.dumps(state)))
            if len(made) >= ENTRY:
                yield _frame(made)
                made = []
        if made:
            yield _frame(made)
        if rest:
            self.waiting.put([tuple(map(list, zip(*rest[n : n + ENTRY]))) for n in range(0, len(rest), ENTRY)])
        else:
            self.waiting.clear()
        if kept:
            self.states.update(tuple(map(list, zip(*kept))))
        else:
            self.states.clear()
        self._wake(timer, max(min(wanted), now + 1) if wanted else None, fired)


def _frame(made: list[tuple]) -> pd.DataFrame:
    keys, parts, times, ties, bodies = zip(*made)
    return pd.DataFrame({"key": keys, "part": parts, "us": times, "tie": pd.array(ties, "Int64"), "body": bodies})


def in_event_order(
    rows: DataFrame, machine: InEventOrder, key: str, part: Column, ts: str, tiebreak: str, body: Column, late: str, once: bool = False, pools: int | None = POOLS
) -> DataFrame:
    """A stream of key, part, us, tie, body: what ``machine`` puts out for each (key, part).

    Rows later than the watermark (``late`` behind the newest) are not taken. ``once``: of rows that carry the same tiebreak within ``late``, one
    is taken. A source that falls silent keeps its last rows waiting; a row with a null key moves the watermark and is left out.
    Keys and tiebreaks are longs; ``part`` is a long made from the column ``_ts``. ``pools``: see ``Pools``; None gives every (key, part) a
    state of its own, for few keys with very many rows.
    """
    instant = F.col(ts)
    if isinstance(rows.schema[ts].dataType, T.TimestampNTZType):
        instant = dates.utc_instant(instant)  # times without a zone are UTC
    timed = rows.select(
        F.col(key).cast("long").alias("key"), F.col(tiebreak).cast("long").alias("_tie"), F.coalesce(body, F.lit("")).alias("_body"), instant.alias("_ts")
    ).withWatermark("_ts", late)
    if once:
        timed = timed.dropDuplicatesWithinWatermark(["_tie"])
    timed = timed.withColumn("_us", F.unix_micros("_ts")).withColumn("part", part.cast("long"))
    if pools is None:
        made = timed.groupBy("key", "part").transformWithState(machine, _OUT, "Append", "EventTime")
        return made.filter("key is not null")
    # A frame makes doubles of a column of longs that holds a null.
    zero = F.lit(0).cast("long")
    pool = F.when(F.col("key").isNull(), F.lit(NO_KEY).cast("long")).otherwise(F.pmod(F.xxhash64("key", "part"), F.lit(pools).cast("long")))
    known = timed.select(
        F.coalesce("key", zero).alias("key"), "part", F.col("_us").alias("us"), F.coalesce("_tie", zero).alias("tie"),
        F.col("_tie").isNull().alias("untied"), F.col("_body").alias("body"), "_ts", pool.alias("pool"),
    )
    return known.groupBy("pool").transformWithStateInPandas(Pools(machine), _OUT, "Append", "EventTime")


def start_writing(made: DataFrame, out: str, state: str) -> StreamingQuery:
    """Take what is there now and write it, each batch in a folder of its own that a replay overwrites."""
    spark = made.sparkSession
    ship_package(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # Timers need the store; the stream takes the setting when it starts, others keep theirs.
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return made.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
