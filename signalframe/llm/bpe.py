"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition that were not met before are merged together: an index maps each
adjacent pair of symbols to all its positions in all those words, a heap gives the active pairs in
ascending rank, and merging a pair visits its positions once and adds the pairs that arise beside them.
Documents are then strings of looked-up words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import table, worker_state
from signalframe.session import ship_package

VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers; at more it forgets all and goes on. Bounds memory, changes no result.
REMEMBERED = 250_000
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Words to ids and back, from the JSON text of a tokenizer with BPE, byte letters and a word-end suffix."""

    def __init__(self, text: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.rank = {a << 32 | b: n for n, (a, b, _) in enumerate(self.merges)}
        self.letter_ids = [self.ids.get(c) for c in byte_letters()]
        self.last_ids = [self.ids.get(c + self.end) for c in byte_letters()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        parts = r"'s|'t|'re|'ve|'m|'ll|'d|"
        letters, numbers, space = "a-z\xaa\xb5\xbaß-öø-\u024f", "0-9²³¹¼-¾", r"\x09-\x0d\x20\x85\xa0"
        self.latin_units = re.compile(parts + f"[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        # The three letters are Latin, but their lower case is not in these blocks.
        self.not_latin = re.compile(r"[^\x00-\u024f]|[\u0130\u023a\u023e]").search
        # Other scripts are normalised and split by the library, whose tables of letters and numbers are the measure.
        self.normalise = Tokenizer.from_str(text).normalizer.normalize_str
        units = Split(Regex(parts + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
        self.units = lambda part: [unit for unit, _ in units.pre_tokenize_str(self.normalise(part))]
        self.known: dict[str, tuple[str, str]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a whole text, in order."""
        out: list[str] = []
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                out.append(part)
            else:
                out += self.units(part) if self.not_latin(part) else self.latin_units(part.lower())
        return out

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Symbols without an id are left out."""
        symbol: list[int] = []
        ends: list[int] = []
        letter, last, rank_of = self.letter_ids, self.last_ids, self.rank.get
        for word in words:
            coded = word.encode()
            symbol += [letter[b] for b in coded[:-1]]
            symbol.append(last[coded[-1]])
            ends.append(len(symbol))
        if None in symbol:
            kept = [0, *accumulate(s is not None for s in symbol)]
            ends, symbol = [kept[e] for e in ends], [s for s in symbol if s is not None]
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        start = 0
        for end in ends:
            if start < end:
                after[end - 1] = before[start] = -1
            start = end
        places: dict[int, list[int]] = defaultdict(list)  # by the rank of the pair
        for at, beyond in enumerate(after):
            if beyond > 0 and (rank := rank_of(symbol[at] << 32 | symbol[beyond])) is not None:
                places[rank].append(at)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.merges[rank]
            for at in sorted(places.pop(rank)):
                gone = after[at]
                if symbol[at] != left or gone < 0 or symbol[gone] != right:
                    continue  # one of the two went into another merge
                symbol[at], symbol[gone] = new, -1
                after[at] = beyond = after[gone]
                if beyond >= 0:
                    before[beyond] = at
                    if (arisen := rank_of(new << 32 | symbol[beyond])) is not None:
                        if arisen not in places:
                            heapq.heappush(active, arisen)
                        places[arisen].append(at)
                ahead = before[at]
                if ahead >= 0 and (arisen := rank_of(symbol[ahead] << 32 | new)) is not None:
                    if arisen not in places:
                        heapq.heappush(active, arisen)
                    places[arisen].append(ahead)
        out, start = [], 0
        for end in ends:
            out.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return out

    def learn(self, words: set[str]) -> None:
        """Remember ids and tokens of words that are not known yet; a word without ids has two empty texts."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        plain = [w for w in new if w not in self.special]
        for word, ids in zip(plain, self.merged(plain), strict=True):
            self.known[word] = " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])
        for word in set(new) & set(self.special):
            self.known[word] = str(self.special[word]), word

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its ids joined by spaces and the decoded text (tokens joined by spaces)."""
        pieces = [self.pieces(t) for t in texts]
        self.learn({w for p in pieces for w in p})
        for p in pieces:
            found = [x for x in map(self.known.__getitem__, p) if x[0]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def loaded(text: str) -> Vocabulary:
    """One vocabulary per worker process, kept over its tasks."""
    return worker_state(f"bpe {hashlib.sha256(text.encode()).hexdigest()}", lambda: Vocabulary(text))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(
    docs: DataFrame,
    path: str | None = None,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    id_col: str = "doc_id",
    text_col: str = "text",
    texts_at_once: int = 512,
) -> DataFrame:
    """doc_id and the ``outputs`` (see ``OUTPUTS``) of every row of ``docs``, row by row, without a shuffle.

    Null and empty texts have no tokens and decode to an empty text. Whole texts are encoded, however
    long; repeated rows give repeated results; a null id stays null; other columns are not read. Special
    tokens written in a text are taken as such, as the library does. The vocabulary is read on the
    driver and broadcast: its size is that of the file (some MB), not of the data.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    schema = ", ".join(f"{c} {t}" for c, t in [("doc_id", dict(docs.dtypes)[id_col]), *((o, OUTPUTS[o]) for o in outputs)])

    def digest(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    make = {
        "n_tokens": (lambda ids, text: ids.count(" ") + 1 if ids else 0, pa.int64()),
        "ids": (lambda ids, text: list(map(int, ids.split())), pa.list_(pa.int32())),
        "decoded": (lambda ids, text: text, pa.string()),
        "ids_sha256": (lambda ids, text: digest(ids), pa.string()),
        "decoded_sha256": (lambda ids, text: digest(text), pa.string()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(start, texts_at_once)
                rows = [[make[o][0](*x) for o in outputs] for x in vocabulary.encode([t or "" for t in part.column(1).to_pylist()])]
                columns = [pa.array(c, make[o][1]) for o, c in zip(outputs, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *outputs])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op1_bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
