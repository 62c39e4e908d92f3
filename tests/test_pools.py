"""Keys in pools: the same rows as with a state per key, with calls to the state store per pool."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from signalframe.streaming.ordered import NO_KEY, Pools
from signalframe.streaming.requests import RequestPlaces
from signalframe.streaming.subscriptions import SubscriptionChanges
from test_streams import Feed, body


class Store:
    """The states and timers of one pool; counts the calls."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), 0

    def getListState(self, name, schema):
        return State(self, name, [])

    def getValueState(self, name, schema):
        return State(self, name, None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class State:
    def __init__(self, store, name, empty):
        self.store, self.name, self.empty = store, name, empty

    def get(self):
        self.store.calls += 1
        found = self.store.held.get(self.name, self.empty)
        return iter(found) if self.empty == [] else found

    def update(self, value):
        self.store.calls += 1
        self.store.held[self.name] = value

    put = update

    def appendList(self, values):
        self.store.calls += 1
        self.store.held[self.name] = [*self.store.held.get(self.name, []), *values]

    def clear(self):
        self.store.calls += 1
        self.store.held.pop(self.name, None)


class Pool:
    """A pool driven as a stream would."""

    def __init__(self, machine):
        self.machine, self.store, self.out = Pools(machine), Store(), []
        self.machine.init(self.store)

    def send(self, rows, watermark, pool=0):
        timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        frames = []
        if rows:
            frame = pd.DataFrame([(k, p, us, tie or 0, tie is None, text) for k, p, us, tie, text in rows], columns=["key", "part", "us", "tie", "untied", "body"])
            frames += self.machine.handleInputRows((pool,), iter([frame[:5], frame[5:]] if len(frame) > 5 else [frame]), timers)
        for at in sorted(t for t in self.store.timers if t <= watermark):
            frames += self.machine.handleExpiredTimer((pool,), timers, None)
            self.store.timers.discard(at)
        for frame in frames:
            self.out += [(k, p, us, None if tie is pd.NA else tie, text) for k, p, us, tie, text in frame.itertuples(index=False)]


def changes(rng):
    kind = rng.choice(["upsert", "upsert", "delete", "deactivate", "verify"])
    return body(kind, token="t", **({"expires": rng.randrange(1, 60_000_000)} if kind == "upsert" else {}))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("machine", [lambda: RequestPlaces(5), lambda: SubscriptionChanges()])
def test_a_pool_gives_what_its_keys_give(machine, seed):
    """Rows up to four seconds out of order, cut into batches, also with quiet batches."""
    rng = random.Random(seed)
    rows = []
    for n in range(300):
        us = rng.randrange(60_000_000)
        part = us // 5_000_000 * 5_000_000 if isinstance(machine(), RequestPlaces) else 0
        rows.append((rng.randrange(7) + (1 << 60), part, us, None if n % 50 == 0 else n, changes(rng)))
    rows.sort(key=lambda r: r[2] + rng.randrange(4_000_000))
    pool, alone, at, mark = Pool(machine()), {}, 0, 0
    while at < len(rows):
        batch = rows[at : (at := at + rng.randrange(40))]
        batch = [r for r in batch if r[2] > mark * 1000]  # later ones are not handed on
        pool.send(batch, mark)
        for r in batch:
            alone.setdefault(r[:2], []).append(r)
        mark = max([mark, *[r[2] // 1000 - 4000 for r in batch]])
        pool.send([], mark)
    pool.send([], 10_000_000)
    want = []
    for key, own in alone.items():
        feed = Feed(machine(), key)
        feed.send([r[2:] for r in own], 0)
        feed.send([], 10_000_000)
        want += [(r.key, r.part, r.us, r.tie, r.body) for r in feed.out]
    assert sorted(pool.out, key=repr) == sorted(want, key=repr) and len(want) > 100
    if isinstance(machine(), RequestPlaces):
        assert pool.store.held == {} and not pool.store.timers


def test_calls_do_not_grow_with_the_keys():
    def calls(keys):
        pool = Pool(RequestPlaces(3600))
        for n in range(3):
            pool.send([(k, 0, 1_000_000 * (k % 9 + 1), k, "") for k in range(n, keys, 3)], 0)
        pool.send([], 10_000_000)
        assert len(pool.out) == keys and pool.store.held == {}
        return pool.store.calls

    assert calls(600) <= calls(30) + 2


def test_calls_do_not_grow_with_the_tokens():
    """Tokens that expire and are verified: one machine state per key, kept to the end."""

    def calls(keys):
        pool = Pool(SubscriptionChanges())
        pool.send([(k, 0, 1_000_000, 2 * k, body("upsert", token=str(k), expires=9_000_000 * (k % 2) + 1_500_000)) for k in range(keys)], 0)
        pool.send([(k, 0, 2_000_000, 2 * k + 1, body("verify", token=str(k))) for k in range(keys)], 0)
        pool.send([], 20_000_000)
        assert len(pool.out) == 2 * keys and len(pool.store.held["states"][0]) == keys and not pool.store.timers
        return pool.store.calls

    assert calls(600) == calls(30)


def test_a_row_is_answered_when_the_watermark_passes_it():
    pool = Pool(RequestPlaces(3600))
    pool.send([(1, 0, 5_000_000, 2, ""), (2, 0, 9_000_000, 3, "")], 0)
    pool.send([], 4999)
    assert pool.out == []
    pool.send([], 5000)
    assert pool.out == [(1, 0, 5_000_000, 2, "1")] and pool.store.timers == {9000}


def test_rows_without_a_key_leave_nothing():
    pool = Pool(RequestPlaces(3600))
    pool.send([(0, 0, 5_000_000, None, "")], 0, pool=NO_KEY)
    assert pool.store.held == {} and not pool.store.timers and pool.out == []
