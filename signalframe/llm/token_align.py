"""Cross-tokenizer alignment by token spans.

Each text is tokenized twice, as space and text: by a byte-level BPE of the tokenizers library (A), whose offsets count characters,
and by a sentencepiece model (B), whose proto has the span of every piece. Where a span ends between two characters it is
a coarse cut; tokens inside a multibyte character and byte-fallback pieces have no such end, and get theirs from
the bytes that they decode to, counted on from the last coarse cut. Offsets where both tokenizers end cut the tokens into
groups.

Neither tokenizer merges over a space that follows a character other than white space, so a text falls into
*units* there. A worker tokenizes each different unit once and remembers it; what is counted over the corpus leaves a chunk of
documents as its different linked id pairs, and comes back to the chunk as one number per pair.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import table, worker_state
from signalframe.session import durable, ship_package

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text handled at a time, and characters tokenized at a time.
CHUNK, BATCH = 4 << 20, 1 << 16
#: Different units that a worker keeps from chunk to chunk; beyond that it begins anew. Results do not depend on it.
REMEMBERED = 400_000
#: A unit goes on over a space only after white space (and after some characters that some tables take for it).
_BLANK = "\\s\u180e\u200b\ufeff"
_UNIT = re.compile(f" (?:[^ ]+|(?<=[{_BLANK}]) )*")
_OPEN = re.compile(f"[{_BLANK}]$")
MASK = (1 << 32) - 1


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: An id and what may follow it in a text of groups: id * 4 + 0 to 3.
        self.names = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (",", "|", ";", "\n")]
        #: Whether texts may be cut into units: no piece of B goes over the start of a word.
        self.cuts = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.byte_spans = self.b.encode("\u00e9", return_type="proto").pieces[-1].end == 2

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(text) if self.cuts else [text]

    def spans(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The text's bytes, ids and byte ends of A's and of B's tokens; None if either decodes to other bytes."""
        raw = text.encode()
        if len(raw) == len(text):
            at = np.arange(len(raw) + 1)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
        found = self.a.encode(text, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        a_cut = at[np.array([end for _, end in found.offsets], np.int64)]
        # B adds the first space itself, except to an empty text: the space after a text's last word is a piece of its own.
        pieces = [(p.id, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces] or [(self.b.piece_to_id("\u2581"), 0)]
        b, end = np.array([i for i, _ in pieces], np.int64), np.array([e for _, e in pieces], np.int64)
        b_cut = end + 1 if self.byte_spans else at[np.minimum(end + 1, len(text))]
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        return raw, a, refine(a_cut, self.a_size[a]), b, refine(b_cut, self.b_size[b])


def refine(cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the span's end where the token ends there, else the decoded bytes since the last such cut."""
    total = np.cumsum(sizes)
    whole = cuts == total
    last = np.maximum.accumulate(np.where(whole, np.arange(len(cuts)), -1))
    base = np.where(last >= 0, cuts[last], 0)
    return np.where(whole, cuts, base + total - np.where(last >= 0, total[last], 0))


class Links:
    """What some units say: per unit the numbers of tokens, groups and links, its groups' text, and its id pairs with repeats."""

    def __init__(self):
        self.counts: list[np.ndarray] = []  # per batch one row per unit: n_a, n_b, n_groups, n_links, different pairs
        self.texts: list[str | None] = []  # None for a unit without tokens
        self.codes: list[np.ndarray] = []  # a << 32 | b
        self.repeats: list[np.ndarray] = []


def align(pair: Pair, units: list[str], out: Links) -> None:
    """Add ``units`` to ``out``, in order. They are tokenized as one text; if that says nothing of single ones, by halves."""
    found = pair.spans("".join(units))
    if found:
        raw, a, a_end, b, b_end = found
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes if len(raw) == sizes.sum() else np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        owner = np.searchsorted(ends, cuts)
    if not found or not np.array_equal(cuts[np.minimum(np.searchsorted(cuts, ends), len(cuts) - 1)], ends):
        if len(units) == 1:
            out.counts.append(np.zeros((1, 5), np.int64)), out.texts.append(None)
            return
        align(pair, units[: len(units) // 2], out)
        align(pair, units[len(units) // 2 :], out)
        return
    ga, gb = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    na, nb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
    # Groups as text: every token's name with what follows it, A's tokens of a group before B's.
    a_stop, b_stop = np.cumsum(na), np.cumsum(nb)
    last = np.zeros(len(cuts), bool)
    last[np.searchsorted(cuts, ends)] = True
    a_mark, b_mark = np.full(len(a), 0), np.full(len(b), 0)
    a_mark[a_stop - 1] = 1
    b_mark[b_stop - 1] = np.where(last, 3, 2)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (b_stop - nb)[ga]] = a * 4 + a_mark
    order[np.arange(len(b)) + a_stop[gb]] = b * 4 + b_mark
    out.texts += "".join(map(pair.names.__getitem__, order.tolist())).split("\n")[:-1]
    # Every token of A with every one of B in its group.
    times = nb[ga]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    wide = len(pair.b_bytes)
    span = wide * len(pair.a_bytes)
    keys = np.repeat(owner[ga] * span + a * wide, times) + b[np.repeat((b_stop - nb)[ga], times) + place]
    keys.sort()
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    out.repeats.append(np.diff(np.r_[new, len(keys)]))
    own, codes = np.divmod(keys[new], span)
    out.codes.append(codes // wide << 32 | codes % wide)
    total = lambda x: np.bincount(owner, x, len(units)).astype(np.int64)
    out.counts.append(np.stack([total(na), total(nb), total(None), total(na * nb), np.bincount(own, minlength=len(units))], 1))


class Memory:
    """Units that a worker has aligned, over its chunks: a unit's number leads to its row."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.texts: list[str | None] = []
        self.row = np.zeros(0, np.int64)  # of a unit's number
        self.counts, self.codes, self.repeats = np.zeros((0, 5), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pair: Pair) -> None:
        """Align the units that came in since the last time."""
        base = len(self.row)
        names = list(islice(self.known, base, None))
        # Units that end in white space would run into the next one.
        alone = np.array([not pair.cuts or _OPEN.search(u) is not None for u in names], bool)
        out, pending, size = Links(), [], 0
        for n in np.flatnonzero(~alone).tolist():
            pending.append(names[n])
            size += len(names[n])
            if size >= BATCH:
                align(pair, pending, out)
                pending, size = [], 0
        if pending:
            align(pair, pending, out)
        for n in np.flatnonzero(alone).tolist():
            align(pair, [names[n]], out)
        row = np.empty(len(names), np.int64)
        row[np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]] = np.arange(base, base + len(names))
        self.row = np.r_[self.row, row]
        self.texts += out.texts
        self.counts = np.concatenate([self.counts, *out.counts], dtype=np.int32)
        self.codes, self.repeats = np.concatenate([self.codes, *out.codes]), np.concatenate([self.repeats, *out.repeats])
        self.starts = np.cumsum(self.counts[:, 4], dtype=np.int64) - self.counts[:, 4]


def expand(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of ``rows``: its place in ``rows``, and each index of its stretch."""
    n = sizes[rows]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(rows)), n), np.repeat(starts[rows], n) + at


def chunk_row(pair: Pair, memory: Memory, ids: list, texts: list[bytes]) -> dict:
    """One chunk of documents: per document its counts and digest, the chunk's different pairs with the number of documents that hold
    them, and packed: per document the places of its pairs among those, and how often each is linked."""
    if len(memory.known) > REMEMBERED:
        memory.clear()
    places = []
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        whole = text and (raw.isascii() or text.encode() == raw)
        places.append(np.fromiter(map(memory.known.__getitem__, pair.units(" " + text)), np.int32) if whole else np.zeros(0, np.int32))
    memory.learn(pair)
    counts, said = memory.counts, memory.texts.__getitem__
    bad = counts[:, 0] == 0

    sums, digests, owners, units = np.zeros((len(ids), 4), np.int64), [], [], []
    for n, own in enumerate(places):
        own = memory.row[own]
        if not len(own) or bad[own].any():
            digests.append("")
            continue
        sums[n] = counts[own, :4].sum(0, dtype=np.int64)
        digests.append(hashlib.sha256(";".join(map(said, own.tolist())).encode()).hexdigest())
        owners.append(np.full(len(own), n)), units.append(own)
    del places
    owners, units = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, units))
    both, often = np.unique(owners << 32 | units, return_counts=True)
    used, entry = np.unique(both & MASK, return_inverse=True)
    _, at = expand(used, memory.starts, counts[:, 4])
    names, local = np.unique(memory.codes[at], return_inverse=True)
    repeats, sizes = memory.repeats[at], counts[used, 4].astype(np.int64)
    pair_of, at = expand(entry, np.cumsum(sizes) - sizes, sizes)
    keys = (both >> 32)[pair_of] << 32 | local[at]
    order = np.argsort(keys)
    keys, times = keys[order], (repeats[at] * often[pair_of])[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    links, times = keys[new], np.add.reduceat(times, new) if len(new) else times
    doc, local = links >> 32, links & MASK
    parts = [np.bincount(doc, minlength=len(ids)), np.diff(local, prepend=0), times]
    packed = zstandard.ZstdCompressor(level=3).compress(b"".join(p.astype(t).tobytes() for p, t in zip(parts, (np.int64, np.int32, np.int64), strict=True)))
    return {
        "ids": ids, "sums": sums.reshape(-1), "digests": digests,
        "codes": names, "docs": np.bincount(local, minlength=len(names)), "n_links": len(links), "packed": packed,
    }


def chunks(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of about ``CHUNK`` bytes of text (at least one document): chunk, and what ``chunk_row`` says."""
    spark = docs.sparkSession
    ship_package(spark)
    byte_bpe, piece_bpe = paths or vocabulary_paths()
    with open(byte_bpe, encoding="utf-8") as a, open(piece_bpe, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    name = f"token_align {byte_bpe} {piece_bpe}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, memory = worker_state(name, lambda: (Pair(*shared.value), Memory()))
        task, made = TaskContext.get().partitionId(), 0

        def flush(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            row = chunk_row(pair, memory, ids, texts)
            types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made]), *(pa.array([v], t) for v, t in zip(row.values(), types, strict=True))], names=["chunk", *row]
            )

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or b""
                ids.append(i), texts.append(text)
                size += len(text) + 64
                if size >= CHUNK:
                    yield flush(ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield flush(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "chunk long, ids array<long>, sums array<long>, digests array<string>, codes array<long>, docs array<long>, n_links long, packed binary"
    return rows.mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """code (a << 32 | b), n (documents that hold the pair linked), best (n is the highest of its A id; ties included)."""
    each = made.select(F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("x.codes", "x.docs")
    counts = each.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # an A id meets at most as many ids as B has
    return counts.join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``paths``: the vocabulary files of A and B, by default the public ones. Texts that are null or empty, or whose bytes
    either tokenizer does not give back, have no tokens: zeros and an empty digest; they add nothing to any count.
    ``n_best``: links whose pair is held by as many documents as the best pair of its A id; ``count_sum``: the
    links' counts added up. Repeated rows and repeated ids are documents of their own. Ids are longs, a null id stays null.
    Texts are tokenized whole, however long; a text without spaces is one unit. An empty table gives an empty result;
    other columns are not read.
    """
    made = durable(chunks(docs, paths, id_col, text_col))
    pairs = made.select("chunk", F.posexplode(F.arrays_zip("codes")).alias("pos", "x")).select("chunk", "pos", F.col("x.codes").alias("code"))
    said = pairs.join(pair_counts(made), "code").groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "best")).alias("said"))
    rows = made.select("chunk", "ids", "sums", "digests", "n_links", "packed").join(said, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for n in range(batch.num_rows):
                ids, sums, digests = (batch.column(c)[n].values for c in (1, 2, 3))
                links, raw = batch.column(4)[n].as_py(), unpack(batch.column(5)[n].as_py())
                sizes = np.frombuffer(raw, np.int64, len(ids))
                steps = np.frombuffer(raw, np.int32, links, 8 * len(ids)).astype(np.int64)
                times = np.frombuffer(raw, np.int64, links, 8 * len(ids) + 4 * links)
                local = np.cumsum(steps)
                said = batch.column(6)[n]
                count, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if said.is_valid:
                    pos, c, b = (said.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    count, best = np.empty(len(pos), np.int64), np.empty(len(pos), bool)
                    count[pos], best[pos] = c, b
                ends = np.r_[0, np.cumsum(sizes)]
                add = lambda x, ends=ends: np.diff(np.r_[0, np.cumsum(x)][ends])
                four = sums.to_numpy().reshape(-1, 4)
                columns = [ids, *(pa.array(four[:, k]) for k in range(4)), pa.array(add(times * best[local])), pa.array(add(times * count[local])), digests]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(run, schema)


def op13_token_align(spark: SparkSession, folder: str) -> DataFrame:
    return alignments(table(spark, folder, "documents"))
