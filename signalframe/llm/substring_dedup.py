"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. The minimiser of a window is the smallest hash of the ``MER``-word runs in
it; consecutive windows that share it travel as one string of words, a super-k-mer, to the bucket
of the minimiser. Equal windows have equal minimisers, so they meet in one bucket, where sorting brings
them together; neighbours are compared word for word before they count as equal.

Before the shuffle each task drops super-k-mers whose whole text it has already seen in a smaller document: what
they say is known, so a passage that a third of the corpus shares is sent once per task, not once per
document. Strings of one bucket are sent as one zstandard block per task and chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table
from signalframe.session import ship_package, task_slots

WINDOW, MER = 13, 3
#: A run of windows is cut at this length, so that a text of one repeated word stays in small pieces.
LONGEST = 64
#: Bytes of text handled at a time in a map task, and bytes of packed strings aimed at per bucket.
CHUNK, BUCKET = 8 << 20, 16 << 20
#: Words longer than this are hashed on their own; the others in blocks.
LONG_WORD, BLOCK = 4096, 1 << 20
NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA3B195354A39B70D)
    return x ^ (x >> _U(32))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(BLOCK + LONG_WORD, base, _U)])


_POWER: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``, from prefix sums over blocks of bytes."""
    if not _POWER:
        _POWER.extend((_powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))))
    power, back = _POWER
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
        short = ends[at:to] - starts[at:to] <= LONG_WORD
        if not short[-1]:
            to -= int(to - at > 1)
            short = short[: to - at]
        high = ends[at:to][short].max(initial=low)
        part = data[low:high][: BLOCK + LONG_WORD].astype(_U) + _U(1)
        part *= power[: len(part)]
        sums = np.empty(len(part) + 1, _U)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = (starts[at:to] - low)[short], (ends[at:to] - low)[short]
        block = out[at:to]
        block[short] = (sums[e] - sums[s]) * back[s]
        for i in np.flatnonzero(~short):
            block[i] = xxhash.xxh64_intdigest(data[starts[at + i] : ends[at + i]].tobytes())
        at = to
    return mixed(out)


def words_of(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and word ends of words joined by single spaces."""
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    if not len(data):
        return data, gaps, gaps
    return data, np.r_[0, gaps + 1], np.r_[gaps, len(data)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def super_kmers(hashes: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share document and minimiser."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(_U)
    mer = min(MER, window)
    runs = hashes[: len(hashes) - mer + 1] * _FACTORS[0]
    for k in range(1, mer):
        runs = runs + hashes[k : len(hashes) - mer + 1 + k] * _FACTORS[k]
    least = sliding_min(mixed(runs), window - mer + 1)
    valid = doc[: len(least)] == doc[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.astype(_U)
    new = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])]
    begin = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    begin = np.flatnonzero(place % LONGEST == 0)
    return at[begin], np.diff(np.r_[begin, len(at)]), least[at[begin]]


def pack_chunk(ids: list[int], marks: list[int], texts: list[bytes], window: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed strings) of some documents. An entry whose windows are known to repeat has no string."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    words = [texts[i].split() for i in order]
    words = [(i, w) for i, w in zip(order, words, strict=True) if len(w) >= window]
    joined = b" ".join([b" ".join(w) for _, w in words])
    sizes = np.array([len(w) for _, w in words], np.int64)
    rows = [i for i, _ in words]
    del words
    data, starts, ends = words_of(joined)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first, windows, least = super_kmers(word_hashes(data, starts, ends), doc, window)
    if not len(first):
        return
    owner = doc[first]
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    id_of, mark_of = np.array([ids[i] for i in rows], np.int64), np.array([marks[i] for i in rows], np.int64)
    strings = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first + windows + window - 2].tolist(), strict=True)]
    earliest: dict[bytes, int] = {}
    id_list = id_of[owner].tolist()
    known = np.array([earliest.setdefault(s, i) < i for s, i in zip(strings, id_list, strict=True)], bool)
    del earliest
    bucket = (least % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    pack = zstandard.ZstdCompressor(level=3).compress
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        send = own[~known[own]]
        head = np.array([len(own)], np.int64).tobytes()
        columns = (id_of[owner[own]], mark_of[owner[own]], first[own] - base[owner[own]], windows[own] * np.where(known[own], -1, 1))
        body = b" ".join([strings[i] for i in send.tolist()])
        yield int(bucket[own[0]]), pack(head + b"".join(c.astype(np.int64).tobytes() for c in columns) + body)


def repeated_spans(blocks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, mark, first word and end word of every stretch of repeated windows in one bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    columns, bodies = [], []
    for block in blocks:
        raw = unpack(block)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        columns.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n))
        if body := raw[8 + 32 * n :]:
            bodies.append(body)
    ids, marks, begin, windows = np.concatenate(columns, axis=1)
    told = windows < 0
    spans = [(ids[told], marks[told], begin[told], begin[told] - windows[told] + window - 1)]
    ids, marks, begin, windows = (x[~told] for x in (ids, marks, begin, windows))
    joined = b" ".join(bodies)
    del bodies, columns
    if len(ids):
        data, starts, ends = words_of(joined)
        hashes = word_hashes(data, starts, ends)
        full = hashes[: len(hashes) - window + 1] * _FACTORS[0]
        for k in range(1, window):
            full += hashes[k : len(hashes) - window + 1 + k] * _FACTORS[k % len(_FACTORS)]
        full = mixed(full)
        base = np.r_[0, np.cumsum(windows + window - 1)[:-1]]
        owner = np.repeat(np.arange(len(ids)), windows)
        place = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
        at = base[owner] + place  # first word of each window
        key = full[at]
        del full, hashes
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        several = order[np.r_[same, False] | np.r_[False, same]]
        several = several[np.lexsort((ids[owner[several]], key[several]))]
        keys, w0, w1 = key[several], starts[at[several]].tolist(), ends[at[several] + window - 1].tolist()
        equal = keys[1:] == keys[:-1]
        text = memoryview(joined)
        group = np.r_[0, np.cumsum(~equal)]
        wrong = [i for i in np.flatnonzero(equal).tolist() if text[w0[i] : w1[i]] != text[w0[i + 1] : w1[i + 1]]]
        if wrong:  # different windows of one hash: tell them apart by their text
            for g in set(group[wrong].tolist()):
                members = np.flatnonzero(group == g)
                names: dict[bytes, int] = {}
                group[members] = [group[-1] + 1 + names.setdefault(joined[w0[i] : w1[i]], len(names)) for i in members.tolist()]
            again = np.lexsort((ids[owner[several]], group))
            several, group = several[again], group[again]
        head = np.r_[True, np.diff(group) != 0] if len(group) else np.zeros(0, bool)
        smallest = ids[owner[several]][head][np.cumsum(head) - 1]
        out = np.zeros(len(owner), bool)
        out[several[ids[owner[several]] > smallest]] = True
        hit = np.flatnonzero(out)
        if len(hit):
            new = np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])]
            a, b = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
            own = owner[a]
            spans.append((ids[own], marks[own], begin[own] + place[a], begin[own] + place[b] + window))
    return tuple(np.concatenate([s[i] for s in spans]) for i in range(4))


def repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Spans (_id, _h, span) of words under a window that also starts in a document with a smaller id.

    ``docs`` has _id (long, ``NO_ID`` for null), _h and text (binary); span is start * 2^32 + end, in words.
    """
    spark = docs.sparkSession
    slots = task_slots(spark)
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * slots, math.ceil(3 * size / BUCKET))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, marks, texts):
            out = list(pack_chunk(ids, marks, texts, window, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block"])

        ids, marks, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = t.as_py() or b""
                ids.append(i), marks.append(h), texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield flush(ids, marks, texts)
                    ids, marks, texts, size = [], [], [], 0
        if ids:
            yield flush(ids, marks, texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(blocks):
            ids, marks, begin, end = repeated_spans(blocks, window)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(begin << 32 | end)], names=["_id", "_h", "span"])

        own, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != own and blocks:
                    yield flush(blocks)
                    blocks = []
                own = bucket
                blocks.append(block.as_py())
        if blocks:
            yield flush(blocks)

    packed = docs.select("_id", "_h", "text").mapInArrow(pack, "bucket int, block binary")
    return packed.repartition(slots, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "_id long, _h long, span long")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept_text")
) -> DataFrame:
    """doc_id and ``outputs`` (n_words, n_removed, kept_text, kept_sha256) of every row of ``docs``.

    A word goes when it lies under a window whose words also start in a document with a smaller id; windows are
    judged on the input. Words that stay are joined by one space. Repeats inside one document and in rows
    with the same id are no reason to remove. A null id (at most one meaning: larger than any other) is
    returned as null. Null texts and texts shorter than a window lose nothing. Equal rows get equal results.
    An empty table gives an empty result; other columns are not read. Ids are longs.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), row_hash(F.col(text_col)).alias("_h"),
        F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"),
    )
    spans = repeats(rows, window).groupBy("_id", "_h").agg(F.collect_list("span").alias("spans"))
    types = {"n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "kept_text": ("string", pa.string()), "kept_sha256": ("string", pa.string())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {o: [] for o in outputs}
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (t.as_py() or b"").split()
                removed = 0
                if spans.is_valid and len(spans.values):
                    codes = np.sort(spans.values.to_numpy())
                    kept, at = [], 0
                    for a, b in zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist(), strict=True):
                        if a > at:
                            kept += words[at:a]
                        at = max(at, b)
                    kept += words[at:]
                    removed = len(words) - len(kept)
                else:
                    kept = words
                text = b" ".join(kept)
                row = {"n_words": len(words), "n_removed": removed}
                if "kept_text" in found:
                    row["kept_text"] = text.decode()
                if "kept_sha256" in found:
                    row["kept_sha256"] = hashlib.sha256(text).hexdigest()
                for o in outputs:
                    found[o].append(row[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[o], types[o][1]) for o in outputs)], names=["doc_id", *outputs])

    schema = ", ".join(["doc_id long", *(f"{o} {types[o][0]}" for o in outputs)])
    return rows.join(spans, ["_id", "_h"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(table(spark, folder, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))
