"""SimHash near-dedup with pivot distance tables.

Fingerprints within ``bits`` of each other agree on all but ``bits`` of 8 bytes, so distinct fingerprints
meet in one bucket per choice of bytes left out: no pair is missed, and a bucket holds at most 2^(8 * bits)
different fingerprints whatever the data. In a bucket, the Hamming distances of each fingerprint to
many reference fingerprints (pivots) are tabled once; by the triangle inequality a pair whose coordinates
differ by more than ``bits`` anywhere is discarded, and survivors are verified on the fingerprints. Large
buckets are first cut along pivot coordinates into overlapping parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import keep_rows, row_hash, table
from signalframe.llm.components import components
from signalframe.session import durable, ship_package, task_slots

SHINGLE, BITS = 3, 2
PIVOTS = np.random.default_rng(11).integers(0, 1 << 64, 24, dtype=np.uint64)
#: Pairs of a bucket of so many rows are compared directly; larger ones are cut by pivots first.
DIRECT = 128


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set where more than half of the shingles' XXH64 have it; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[shingle - 1 :], strict=False) if len(words) >= shingle else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a : b - 1], 42) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def distances(prints: np.ndarray) -> np.ndarray:
    """The pivot table: one row per fingerprint, one column per pivot."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def survivors(prints: np.ndarray, pivots: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those that the pivots do not discard and that are within ``bits``."""
    for columns in (slice(0, 4), slice(4, None)):
        near = (np.abs(pivots[a, columns] - pivots[b, columns]) <= bits).all(1)
        a, b = a[near], b[near]
    near = np.bitwise_count(prints[a] ^ prints[b]) <= bits
    return a[near], b[near]


def linked(prints: np.ndarray, pivots: np.ndarray, rows: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs among ``rows``. A cut at m sends coordinates up to m left and from m - bits + 1 right: any
    linked pair is together on one side."""
    if len(rows) > DIRECT:
        spread = pivots[rows].std(0)
        for p in np.argsort(-spread):
            values = pivots[rows, p]
            m = int(np.median(values))
            left, right = rows[values <= m], rows[values >= m - bits + 1]
            if max(len(left), len(right)) <= 0.9 * len(rows):
                yield from linked(prints, pivots, left, bits)
                yield from linked(prints, pivots, right, bits)
                return
    for start in range(0, len(rows), DIRECT):
        block = np.arange(start, min(start + DIRECT, len(rows)))
        for other in range(start, len(rows), DIRECT):
            with_ = np.arange(other, min(other + DIRECT, len(rows)))
            a, b = np.repeat(block, len(with_)), np.tile(with_, len(block))
            yield survivors(prints, pivots, rows[a[a < b]], rows[b[a < b]], bits)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all the pairs connect, at most one per row."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append((x, y))
    return kept


def bucket_links(bits: int):
    """A map over rows (k, f) sorted by bucket k, to links (a, b) between fingerprints."""

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
        sizes = ends - starts
        several = (np.repeat(sizes, sizes) > 1)
        if not several.any():
            return
        f, left = f[several], np.repeat(ends, sizes)[several] - np.flatnonzero(several)  # rows from here to the bucket's end
        large = np.repeat(sizes, sizes)[several] > DIRECT
        prints = f.view(np.uint64)
        pivots = distances(prints)
        found = []
        small = np.flatnonzero(~large)
        step = 1
        while len(small := small[left[small] > step]):
            found.append(survivors(prints, pivots, small, small + step, bits))
            step += 1
        at = 0
        big = np.flatnonzero(large)
        while at < len(big):
            size = int(left[big[at]])
            found += linked(prints, pivots, big[at : at + size], bits)
            at += size
        a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        kept = np.array(forest(a, b), np.int64).reshape(-1, 2)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(f[kept[:, 0]]), pa.array(f[kept[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k = np.r_[k, batch.column(0).to_numpy()]
            f = np.r_[f, batch.column(1).to_numpy()]
            if len(k):
                last = int(np.searchsorted(k, k[-1]))  # the bucket that may go on in the next batch
                yield from links(k[:last], f[:last])
                k, f = k[last:], f[last:]
        yield from links(k, f)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _h (hash of the text), f (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "_h", "f"])

    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(F.col(text_col)).alias("_h"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, _h long, f long")


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect all of the different fingerprints ``f`` within ``bits`` of each other."""
    keys = []
    for n, left_out in enumerate(combinations(range(8), bits)):
        mask = sum(0xFF << 8 * byte for byte in range(8) if byte not in left_out)
        tag = (n & 0xFF) << 8 * left_out[0] if left_out else 0  # keeps buckets of different choices apart
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        keys.append(F.col("f").bitwiseAND(F.lit(signed(mask))).bitwiseOR(F.lit(signed(tag))))
    rows = prints.select("f", F.explode(F.array(*keys)).alias("k")).select("k", "f")
    slots = task_slots(prints.sparkSession)
    return rows.repartition(slots, "k").sortWithinPartitions("k", "f").mapInArrow(bucket_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, _h, kept_key (id and hash of the row that stays).

    Null and empty texts and texts without words have fingerprint zero, linked like any other. Texts with
    fewer words than a shingle are one shingle. component_id is the smallest id that is reachable over
    links; a null id is larger than any other. Equal rows get equal results. An empty table gives an
    empty result; other columns are not read.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h")))
    prints = durable(rows.groupBy("f").agg(first.alias("first")))
    roots = components(near_links(prints.select("f"), bits)).withColumnRenamed("node", "f")
    rooted = prints.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("key"))
    classes = rooted.select("f", "root").join(whole, "root").select("f", "key")
    return rows.join(classes, "f").select(
        "doc_id",
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.col("key.id").alias("component_id"),
        "_h",
        F.col("key").alias("kept_key"),
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The row of each component that has the smallest id (then text hash), all columns kept."""
    found = near_duplicates(docs, id_col, text_col, shingle, bits)
    kept = found.filter(F.col("kept_key.h") == F.col("_h")).filter(F.col("kept_key.id").eqNullSafe(F.col("doc_id")))
    return keep_rows(docs, kept.select(F.col("doc_id").alias("_id"), "_h"), id_col, text_col)


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")
