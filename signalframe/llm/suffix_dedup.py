"""Substring dedup by longest-previous-factor arrays.

A window is ``LENGTH`` consecutive bytes of one document. In suffix order, the previous and the next position that is smaller in the text give each
window its longest earlier match (LPF); mirrored, the previous and next larger position give the longest later one (LNF). A window
repeats where one of them reaches ``LENGTH``: later copies alone go (``keep_first``) or all of them.

One suffix array over everything does not spread over tasks, so windows are first brought together by content. The anchor of a window is the place of the
smallest hash among its first ``gap`` positions; equal windows have equal anchors at equal places. Consecutive windows
with one anchor form a run, and the bytes from the anchor on that all of its windows hold are its core:

1. cores are counted over the corpus. A window whose core occurs once cannot repeat, and its text travels no further;
2. runs go to the bucket of their core as strings, equal ones of a chunk once; each bucket has its own suffix array;
3. a core of very many runs would fill a bucket with strings that differ only around it. The windows of such cores travel one by one as digests,
   equal ones of a chunk as one row, and equal digests are equal classes of the suffix order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table
from signalframe.session import durable, ship_package, task_slots

LENGTH = 400
#: Bytes of text handled at a time in a map task, and bytes of strings aimed at per bucket.
CHUNK, BUCKET = 4 << 20, 2 << 20
#: Runs of one core in one bucket at most; the windows of a core with more travel one by one.
HEAVY = 2000
NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other

_U = np.uint64
_FACTORS = np.random.default_rng(17).integers(1, 1 << 63, (2, 512), dtype=_U) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA3B195354A39B70D)
    return x ^ (x >> _U(32))


def gap_of(length: int) -> int:
    """Positions among which a window of ``length`` bytes has its anchor."""
    return max(1, length * 5 // 8)


def words_at(data: bytes, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the data."""
    padded = data + bytes(16)
    return np.ndarray(len(data) + 8, kind, padded, strides=(1,))


def stretch_hash(words: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``size`` bytes from each place ``at`` on."""
    steps = [*range(0, size - 7, 8), *([size - 8] if size % 8 and size > 8 else [])] or [0]
    out = np.zeros(len(at), _U)
    for k, step in enumerate(steps):
        piece = words[at + step]
        out += (piece & _U((1 << 8 * size) - 1) if size < 8 else piece) * _FACTORS[which, k % 512] + (out >> _U(17) if k % 512 == 511 else _U(0))
    return mixed(out)


class Windows:
    """The windows of some documents: their runs by anchor, and a hash of each run's core."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes) - sizes
        self.words = words_at(self.data)
        self.length, gap = length, gap_of(length)
        mer = min(16, length - gap + 1)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.first = self.count = self.anchor = self.doc = none
        self.core = none.astype(_U)
        if n < length:
            return
        places = max(n - mer + 1, 1)
        keys = stretch_hash(self.words, np.arange(places), mer) if mer != 16 else mixed(
            self.words[:places] * _FACTORS[0, 0] + self.words[8 : places + 8] * _FACTORS[0, 1]
        )
        # The place stands in the low bits: the least key is the leftmost of equal hashes.
        low = _U((1 << int(n).bit_length()) - 1)
        keys = (keys & ~low) | np.arange(places, dtype=_U)
        have = 1
        while have < gap:
            step = min(have, gap - have)
            keys = np.minimum(keys[:-step], keys[step:])
            have += step
        free = np.maximum(sizes - length + 1, 0)  # windows per document
        start = np.arange(free.sum()) + np.repeat(self.begin - (np.cumsum(free) - free), free)
        if not len(start):
            return
        anchor = (keys[start] & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        self.first, self.anchor = start[new], anchor[new]
        self.count = np.diff(np.r_[new, len(start)])
        self.doc = np.searchsorted(np.cumsum(sizes), self.first, side="right")
        self.core = stretch_hash(self.words, self.anchor, length - gap + 1)


# --- The suffix order of one bucket


def rank_tables(data: bytes, cap: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of each position by its first h bytes) for h = 8, 16, ... up to ``cap``: prefix doubling."""
    words = words_at(data, ">u8")[: len(data)].astype(_U)
    tables, h = [], 8
    while h <= max(cap, 8):
        order = np.argsort(words)
        ordered = words[order]
        rank = np.empty(len(data), np.int32)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        tables.append((h, rank))
        words = rank.astype(_U) << _U(32)
        if h < len(data):
            words[: len(data) - h] |= (rank[h:] + 1).astype(_U)
        h *= 2
    return tables


def common_length(tables: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that the positions a and b have in common, up to ``cap``; at least ``cap`` bytes follow both."""
    out = np.zeros(len(a), np.int64)
    for n, (h, rank) in enumerate(reversed(tables)):
        for _ in range(cap // h if n == 0 else 1):
            fits = np.flatnonzero(out + h <= cap)
            at = out[fits]
            out[fits[rank[a[fits] + at] == rank[b[fits] + at]]] += h
    for _ in range(7):  # ranks know steps of eight
        fits = np.flatnonzero(out < cap)
        at = out[fits]
        out[fits[data[a[fits] + at] == data[b[fits] + at]]] += 1
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 without: pointers jump over what is known to be larger.

    Few are left after some rounds; each of those then walks on alone.
    """
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    for _ in range(64):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    if len(open_):
        held, jump = values.tolist(), at.tolist()
        for n in open_.tolist():  # ascending: what is jumped over has settled before
            k = jump[n]
            while k >= 0 and held[k] > held[n]:
                k = jump[k]
            jump[n] = k
        at = np.array(jump)
    return at


def longest_factors(data: bytes, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """LPF and LNF of the positions ``starts`` (ascending), up to ``cap`` bytes: the longest match with an earlier, with a later one.

    At least ``cap`` bytes follow every start.
    """
    tables = rank_tables(data, cap)
    h, rank = tables[-1]
    order = starts
    if h < cap:  # two overlapping ranks make the rank by ``cap`` bytes
        keys, steps = rank[starts].astype(np.int64), range(h, cap, h)
        for step in steps:
            keys = keys * (len(data) + 1) + rank[starts + min(step, cap - h)]
            _, keys = np.unique(keys, return_inverse=True)
    else:
        keys = rank[starts].astype(np.int64)
    order = np.argsort(keys * len(starts) + np.arange(len(starts)))
    suffixes = starts[order]
    raw = np.frombuffer(data, np.uint8)

    def best(values: np.ndarray) -> np.ndarray:
        """The longer of the matches with the nearest smaller values on both sides."""
        out = np.zeros(len(values), np.int64)
        for side in (previous_smaller(values), len(values) - 1 - previous_smaller(values[::-1])[::-1]):
            has = np.flatnonzero((side >= 0) & (side < len(values)))
            out[has] = np.maximum(out[has], common_length(tables, raw, suffixes[has], suffixes[side[has]], cap))
        found = np.empty(len(values), np.int64)
        found[order] = out
        return found

    return best(suffixes), best(-suffixes)


# --- Runs to buckets


def pack_runs(ids: list[int], marks: list[int], texts: list[bytes], light: np.ndarray, length: int, buckets: int, keep_first: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed runs) of some documents, for the runs whose core is in ``light``. Equal strings are sent once."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i]))
    made = Windows([texts[i] for i in order], length)
    runs = np.flatnonzero(np.isin(made.core, light))
    if not len(runs):
        return
    id_of, mark_of = np.array(ids, np.int64)[order], np.array(marks, np.int64)[order]
    doc, first, count, core = made.doc[runs], made.first[runs], made.count[runs], made.core[runs]
    columns = np.stack([id_of[doc], mark_of[doc], first - made.begin[doc], count, np.zeros(len(runs), np.int64), core.view(np.int64)])
    strings = [made.data[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    head = np.fromiter((seen.setdefault(s, n) for n, s in enumerate(strings)), np.int64, len(strings))
    columns[4] = np.bincount(head, minlength=len(runs))  # how often the string occurs, 0 for those that are not sent
    again = columns[4] == 0
    same = (columns[:3] == columns[:3, head]).all(0)  # a repeated row says what its first one said
    keep = ~(again & same) if keep_first else np.ones(len(runs), bool)
    bucket = (core % _U(buckets)).astype(np.int64)
    order = np.flatnonzero(keep)
    order = order[np.argsort(bucket[order], kind="stable")]
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    pack = zstandard.ZstdCompressor(level=3).compress
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        body = b"".join([strings[i] for i in own[columns[4, own] > 0].tolist()])
        yield int(bucket[own[0]]), pack(len(own).to_bytes(8, "little") + np.ascontiguousarray(columns[:, own]).tobytes() + body)


def stretches(ids: np.ndarray, marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of bytes (id, mark, begin, end), those that overlap in one."""
    order = np.lexsort((end, begin, marks, ids))
    ids, marks, begin, end = (x[order] for x in (ids, marks, begin, end))
    if not len(ids):
        return ids, marks, begin, end
    other = np.r_[True, (np.diff(ids) != 0) | (np.diff(marks) != 0)]
    # Ends rise within a document and fall back at the next: an offset per document makes one running maximum of them.
    lift = np.cumsum(other) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.flatnonzero(other | np.r_[True, begin[1:] > reach[:-1]])
    return ids[new], marks[new], begin[new], reach[np.r_[new[1:] - 1, len(end) - 1]]


def repeated_in_bucket(blocks: list[bytes], length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, mark, begin and end of the bytes under windows of one bucket that repeat."""
    unpack = zstandard.ZstdDecompressor().decompress
    heads, strings = [], []
    for block in blocks:
        raw = unpack(block)
        n = int.from_bytes(raw[:8], "little")
        columns = np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n)
        heads.append(columns)
        sizes = np.where(columns[4] > 0, columns[3] + length - 1, 0)
        ends = 8 + 48 * n + np.cumsum(sizes)
        strings += [raw[e - s : e] if s else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    ids, marks, begin, count, times, core = np.concatenate(heads, axis=1)
    whole = times == 0  # equal to another string of its chunk
    sent = np.flatnonzero(~whole)
    sent = sent[np.lexsort((begin[sent], marks[sent], ids[sent]))]
    seen: dict[bytes, int] = {}
    head = np.fromiter((seen.setdefault(strings[n], n) for n in sent.tolist()), np.int64, len(sent))
    if keep_first:
        whole[sent] = (ids[sent] != ids[head]) | (marks[sent] != marks[head]) | (begin[sent] != begin[head])
    else:
        whole[sent] = (np.bincount(head, times[sent], len(ids)) > 1)[head]
    out = [(ids[whole], marks[whole], begin[whole], begin[whole] + count[whole] + length - 1)]
    # Different strings of one core may share some windows.
    firsts = sent[head == sent]
    _, group, size = np.unique(core[firsts], return_inverse=True, return_counts=True)
    firsts = firsts[size[group] > 1]
    if len(firsts):
        data = b"".join([strings[n] for n in firsts.tolist()])
        offset = np.cumsum(count[firsts] + length - 1) - (count[firsts] + length - 1)
        owner = np.repeat(firsts, count[firsts])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count[firsts]) - count[firsts], count[firsts])
        lpf, lnf = longest_factors(data, np.repeat(offset, count[firsts]) + place, length)
        hit = np.flatnonzero(lpf >= length if keep_first else (lpf >= length) | (lnf >= length))
        at = begin[owner[hit]] + place[hit]
        out.append((ids[owner[hit]], marks[owner[hit]], at, at + length))
    return stretches(*(np.concatenate([o[k] for o in out]) for k in range(4)))


def digest_rows(ids: list[int], marks: list[int], texts: list[bytes], heavy: np.ndarray, length: int) -> dict:
    """The different windows, by two digests, of the runs whose core is in ``heavy``, and where each is."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i]))
    made = Windows([texts[i] for i in order], length)
    runs = np.flatnonzero(np.isin(made.core, heavy))
    count = made.count[runs]
    at = np.repeat(made.first[runs], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(made.doc[runs], count)
    c = np.repeat(made.core[runs], count).view(np.int64)
    g = stretch_hash(made.words, at, length, 1).view(np.int64)
    sort = np.lexsort((np.arange(len(at)), c, g))
    g, c, at, owner = g[sort], c[sort], at[sort], owner[sort]
    new = np.flatnonzero(np.r_[True, (np.diff(g) != 0) | (np.diff(c) != 0)]) if len(g) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[new, len(g)].astype(np.int32))
    lists = [np.array(ids, np.int64)[order][owner], np.array(marks, np.int64)[order][owner], at - made.begin[owner]]
    return {"g": pa.array(g[new]), "c": pa.array(c[new]), **{k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in zip(("ids", "marks", "places"), lists, strict=True)}}


def core_rows(ids: list[int], marks: list[int], texts: list[bytes], length: int) -> dict:
    """Per document with a window the hashes of its runs' cores, each at most twice."""
    made = Windows(texts, length)
    order = np.lexsort((made.core, made.doc))
    doc, core = made.doc[order], made.core[order]
    same = (doc[2:] == doc[:-2]) & (core[2:] == core[:-2])
    kept = np.r_[np.ones(min(2, len(doc)), bool), ~same]
    doc, core = doc[kept], core[kept]
    new = np.flatnonzero(np.r_[True, np.diff(doc) != 0]) if len(doc) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[new, len(doc)].astype(np.int32))
    return {
        "_id": pa.array(np.array(ids, np.int64)[doc[new]]), "_h": pa.array(np.array(marks, np.int64)[doc[new]]),
        "cores": pa.ListArray.from_arrays(offsets, pa.array(core.view(np.int64))),
    }


def by_chunk(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, list, list]]:
    """ids, marks, texts and the remaining columns' values of about CHUNK bytes of rows, without texts that have no window."""
    ids, marks, texts, others, size = [], [], [], [], 0
    for batch in batches:
        rest = [batch.column(k) for k in range(3, batch.num_columns)]
        for n, (i, h, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
            text = t.as_py() or b""
            if len(text) < length:
                continue
            ids.append(i), marks.append(h), texts.append(text)
            others.append([c[n].values.to_numpy() if c[n].is_valid else np.zeros(0, np.int64) for c in rest])
            size += len(text)
            if size >= CHUNK:
                yield ids, marks, texts, others
                ids, marks, texts, others, size = [], [], [], [], 0
    if ids:
        yield ids, marks, texts, others


def union(others: list[list[np.ndarray]], k: int) -> np.ndarray:
    return np.unique(np.concatenate([o[k] for o in others])).view(_U)


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, heavy: int | None = None) -> DataFrame:
    """Spans (_id, _h, span) of bytes under windows that repeat; span is begin * 2^32 + end.

    ``docs`` has _id (long, ``NO_ID`` for null), _h, text (binary) and may have more; its exchange on (_id, _h) is shared with a later join on them.
    """
    heavy = HEAVY if heavy is None else heavy
    slots = task_slots(docs.sparkSession)
    text = docs.select("_id", "_h", "text")

    def cores(batches):
        for ids, marks, texts, _ in by_chunk(batches, length):
            rows = core_rows(ids, marks, texts, length)
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    # 1. Which cores occur more than once? Written, so that texts are hashed once and both sides of the join can be split.
    own = durable(text.mapInArrow(cores, "_id long, _h long, cores array<long>"))
    counted = own.select(F.explode("cores").alias("core")).groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    recurring = durable(counted.select("core", "n", (F.col("n") > heavy).alias("heavy")))
    light_runs = recurring.filter("not heavy").agg(F.sum("n")).first()[0] or 0
    buckets = max(slots, math.ceil(light_runs * (length + gap_of(length) / 2) / BUCKET))
    found = (
        own.select("_id", "_h", F.explode(F.array_distinct("cores")).alias("core"))
        .join(recurring, "core")
        .groupBy("_id", "_h")
        .agg(F.collect_set(F.when(~F.col("heavy"), F.col("core"))).alias("light"), F.collect_set(F.when(F.col("heavy"), F.col("core"))).alias("heavy"))
    )
    candidates = docs.join(found, ["_id", "_h"])

    # 2. Runs of ordinary cores as strings.
    def pack(batches):
        for ids, marks, texts, others in by_chunk(batches, length):
            out = list(pack_runs(ids, marks, texts, union(others, 0), length, buckets, keep_first))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block"])

    def settle(batches):
        def flush(blocks):
            ids, marks, begin, end = repeated_in_bucket(blocks, length, keep_first)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(begin << 32 | end)], names=["_id", "_h", "span"])

        at, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at and blocks:
                    yield flush(blocks)
                    blocks = []
                at = bucket
                blocks.append(block.as_py())
        if blocks:
            yield flush(blocks)

    packed = candidates.filter(F.size("light") > 0).select("_id", "_h", "text", "light").mapInArrow(pack, "bucket int, block binary")
    spans = packed.repartition(slots, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, "_id long, _h long, span long")
    if not recurring.filter("heavy").isEmpty():
        spans = spans.unionByName(heavy_spans(candidates, length, keep_first))
    return spans


def heavy_spans(candidates: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """As ``repeats``, for the windows of heavy cores: a class of equal windows has one row per chunk that holds it."""

    def digests(batches):
        for ids, marks, texts, others in by_chunk(batches, length):
            rows = digest_rows(ids, marks, texts, union(others, 0), length)
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    schema = "g long, c long, ids array<long>, marks array<long>, places array<long>"
    rows = candidates.filter(F.size("heavy") > 0).select("_id", "_h", "text", "heavy").mapInArrow(digests, schema)
    equal = Window.partitionBy("g", "c")
    least = F.min(F.struct(F.col("ids")[0].alias("i"), F.col("marks")[0].alias("m"), F.col("places")[0].alias("p"))).over(equal)
    known = rows.withColumn("n", F.sum(F.size("ids")).over(equal)).withColumn("least", least).filter("n > 1")
    each = known.select("least", F.explode(F.arrays_zip("ids", "marks", "places")).alias("x"))
    if keep_first:
        each = each.filter(F.struct(F.col("x.ids").alias("i"), F.col("x.marks").alias("m"), F.col("x.places").alias("p")) != F.col("least"))
    begin = F.shiftleft(F.col("x.places"), 32)
    return each.select(F.col("x.ids").alias("_id"), F.col("x.marks").alias("_h"), begin.bitwiseOR(F.col("x.places") + length).alias("span"))


OUTPUTS = {
    "n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()),
    "kept": ("binary", pa.binary()), "kept_sha256": ("string", pa.string()), "removed": ("array<bigint>", pa.list_(pa.int64())),
}


def dedup_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False,
    outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"), heavy: int | None = None,
) -> DataFrame:
    """doc_id and ``outputs`` of every row of ``docs``: n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: a cut may fall into a character), kept_sha256,
    removed (begin, end, begin, end, ...).

    A byte of the UTF-8 text goes when a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another;
    strings may overlap, and are judged on the input. With ``keep_first``, the string that starts first (by id, text hash,
    place) stays, and so do rows that repeat it with id and text. Null counts as empty; empty texts and texts shorter than ``length`` lose
    nothing. Repeated rows are repeats like any other: without ``keep_first`` both lose all. A null id is larger than any other and returned as null.
    Very long texts are handled whole, in a chunk of their own. An empty table gives an empty result; other columns are not read. Ids are longs.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), row_hash(F.col(text_col)).alias("_h"),
        F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"),
    )
    spans = repeats(rows, length, keep_first, heavy).groupBy("_id", "_h").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {o: [] for o in outputs}
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = t.as_py() or b""
                kept, removed, at = text, [], 0
                if spans.is_valid and len(spans.values):
                    codes = np.sort(spans.values.to_numpy())
                    begin, end = codes >> 32, np.maximum.accumulate(codes & 0xFFFFFFFF)
                    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                    begin, end = begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]
                    removed = np.stack([begin, end], 1).reshape(-1).tolist()
                    kept = b"".join([text[a:b] for a, b in zip([0, *removed[1::2]], [*removed[::2], len(text)], strict=True)])
                row = {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(removed) // 2, "kept": kept, "removed": removed}
                if "kept_sha256" in found:
                    row["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                for o in outputs:
                    found[o].append(row[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[o], OUTPUTS[o][1]) for o in outputs)], names=["doc_id", *outputs])

    schema = ", ".join(["doc_id long", *(f"{o} {OUTPUTS[o][0]}" for o in outputs)])
    return rows.join(spans, ["_id", "_h"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_bytes(table(spark, folder, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))
