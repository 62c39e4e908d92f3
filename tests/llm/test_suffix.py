"""Substring dedup by longest-previous-factor arrays against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import compress

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalframe.llm import suffix_dedup
from signalframe.llm.suffix_dedup import Windows, dedup_bytes, longest_factors, op11_suffix_dedup, previous_smaller


def common(data, a, b, cap):
    n = 0
    while n < cap and data[a + n] == data[b + n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.integers(1, 40), st.integers(0, 9))
def test_factors(text, cap, skip):
    data = text.encode()
    starts = np.array([i for i in range(len(data) - cap + 1) if i % 10 != skip], np.int64)
    if not len(starts):
        return
    lpf, lnf = longest_factors(data, starts, cap)
    every = starts.tolist()
    assert lpf.tolist() == [max((common(data, i, j, cap) for j in every if j < i), default=0) for i in every]
    assert lnf.tolist() == [max((common(data, i, j, cap) for j in every if j > i), default=0) for i in every]


@given(st.lists(st.integers(0, 30), max_size=50, unique=True))
def test_previous_smaller(values):
    wanted = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert previous_smaller(np.array(values, np.int64)).tolist() == wanted


def test_previous_smaller_of_long_climbs():
    values = np.r_[np.arange(1000, 2000), np.arange(0, 1000, 7), np.arange(2000, 3000), [500, 499, 0.5, 2500, 1]]
    wanted = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert previous_smaller(values).tolist() == wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=6), st.integers(1, 30))
def test_equal_windows_have_equal_cores(texts, length):
    texts = [t.encode() for t in texts]
    made = Windows(texts, length)
    joined, cores = b"".join(texts), {}
    assert made.count.sum() == sum(max(0, len(t) - length + 1) for t in texts)
    for first, count, core, anchor in zip(made.first.tolist(), made.count.tolist(), made.core.tolist(), made.anchor.tolist(), strict=True):
        for s in range(first, first + count):
            assert cores.setdefault(joined[s : s + length], (core, anchor - s)) == (core, anchor - s)


def expected(docs, length, keep_first=False):
    """docs: (id, text) rows; a removed byte is under a window that repeats."""
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0))
    texts = [(docs[n][1] or "").encode() for n in range(len(docs))]
    places = {}
    for n in order:
        for s in range(len(texts[n]) - length + 1):
            places.setdefault(texts[n][s : s + length], []).append((n, s))
    gone = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            first = found[0]
            for n, s in found:
                stays = keep_first and s == first[1] and docs[n] == docs[first[0]]
                if not stays:
                    gone[n][s : s + length] = b"\1" * length
    rows = []
    for (i, _), raw, out in zip(docs, texts, gone, strict=True):
        kept = bytes(compress(raw, (not x for x in out)))
        rows.append((i, len(raw), sum(out), sum(1 for part in out.split(b"\0") if part), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def found(df, **settings):
    made = dedup_bytes(df, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), **settings)
    return sorted((tuple(r) for r in made.collect()), key=repr)


def patchwork(n, seed):
    """Texts that share passages, lines and whole copies; one of them is in half of all rows."""
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = ["".join(rng.choice("abc 漢") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(some))
        if i % 2:
            parts.insert(rng.randint(0, len(parts)), some[0])
        out.append((i, "".join(parts)))
    return out + [(1000 + i, out[i % 7][1]) for i in range(20)] + [(2000, "ab" * 200), (2001, "z" * 150), (2002, None), (2003, "")]


@pytest.mark.parametrize("heavy", [None, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_patchwork(spark, monkeypatch, heavy, keep_first):
    docs = patchwork(120, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    assert found(df, length=40, heavy=heavy, keep_first=keep_first) == expected(docs, 40, keep_first)


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((tuple(r) for r in op11_suffix_dedup(spark, folder).collect()), key=repr)
    assert rows == expected(docs, 400) and sum(r[2] for r in rows) > 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_odd_rows(odd, plain_odd, none, keep_first):
    docs = [(i, t) for i, t, *_ in plain_odd]
    df = odd.withColumns({c: odd["doc_id"] for c in ("core", "cores", "n", "span", "bucket", "removed", "light", "heavy")})
    assert found(df, length=30, keep_first=keep_first) == expected(docs, 30, keep_first)
    assert dedup_bytes(none).collect() == []


def test_spans_and_bytes_that_stay(spark):
    same = "x y z " * 10
    df = spark.createDataFrame([(1, "é" + same + "ü"), (2, same)], "doc_id long, text string")
    rows = {r.doc_id: r for r in dedup_bytes(df, length=50, outputs=("kept", "removed")).collect()}
    assert bytes(rows[1].kept) == "éü".encode() and rows[1].removed == [2, 62]
    assert bytes(rows[2].kept) == b"" and rows[2].removed == [0, 60]
    assert Counter(r.doc_id for r in dedup_bytes(df).collect()) == {1: 1, 2: 1}
