"""Language identification with a linear-chain conditional random field over words.

A word's emission score per language is a sum of learned weights of its affixes, letter n-grams and lexicon
memberships; learned transition weights say how languages follow each other. Training texts are
cut into short runs and dealt into code-switched sequences, so transitions are learned from switches too. Forward and backward sums
give each word its probability per language; a document's language has the largest mean.

The model is fitted on a bounded sample (``DOCS`` documents per language, ``LETTERS`` code points of each, from a place that
its hash picks) on the driver; every document is labelled on all of its words, in tasks.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table, worker_state
from signalframe.session import ship_package

DOCS, LETTERS = 250, 3000
BUCKETS = 1 << 15
#: Length of a training sequence, mean length of a run of one language in it, passes over the sample, ridge penalty.
SEQUENCE, RUN, PASSES, RIDGE = 48, 12, 40, 0.02
#: A word is in the lexicon of a language that has at least this share of its (three or more) occurrences.
LEXICON_SHARE, LEXICON_COUNT = 0.8, 3
#: Words a worker remembers; at more it forgets all and goes on. Bounds memory, changes no result.
REMEMBERED = 250_000
#: Words labelled at a time, bounds memory.
WORDS = 1 << 18
UNDETERMINED = "und"

words_in = re.compile(r"[^\W\d_]+").findall


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed affixes (1 to 3 letters), n-grams (2 and 3 letters, with word ends) and the lexicon that has the word."""
    w = f"<{word}>"
    parts = {"p" + w[:n] for n in (2, 3, 4)} | {"s" + w[-n:] for n in (2, 3, 4)}
    parts |= {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    out = [zlib.crc32(p.encode()) % BUCKETS for p in sorted(parts)]
    if word in lexicon:
        out.append(BUCKETS + lexicon[word])
    return out


class Model:
    """Weights per feature and language, transitions and the lexicon."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        self.name = uuid.uuid4().hex
        self.languages, self.lexicon = languages, lexicon
        n = len(languages)
        self.weights = np.zeros((BUCKETS + n, n), np.float32)
        self.transitions = np.zeros((n, n), np.float32)
        self.begin = np.zeros(n, np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """One row of scores per word; a word without a letter gets NaN."""
        cleaned = ["".join(filter(str.isalpha, w)) for w in words]
        lists = [features(w, self.lexicon) if w else [0] for w in cleaned]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((f for x in lists for f in x), np.int64, int(counts.sum()))
        scores = np.add.reduceat(self.weights[flat], np.r_[0, np.cumsum(counts)[:-1]], axis=0)
        scores[[not w for w in cleaned]] = np.nan
        return scores


def posteriors(model: Model, rows: np.ndarray, lengths: np.ndarray, scores: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of each sequence the mean probability per language and the mean of its words' largest, and (``whole``) the probabilities of each word.

    ``rows`` are score rows of all words, sequence after sequence. All sequences advance together, one word per
    step; longest first, so those still running are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="left")
    offset = np.r_[0, np.cumsum(alive)]
    emit = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    move = np.exp(model.transitions - model.transitions.max())
    ahead = np.empty((int(offset[-1]), len(model.languages)), np.float32)
    state = np.exp(model.begin - model.begin.max())[None, :].repeat(len(sizes), 0)
    for t, n in enumerate(alive.tolist()):
        state = (state[:n] @ move if t else state[:n]) * emit[rows[starts[:n] + t]]
        state /= state.sum(1, keepdims=True)
        ahead[offset[t] : offset[t + 1]] = state
    total, certain = np.zeros((len(sizes), len(model.languages))), np.zeros(len(sizes))
    every = np.empty((len(rows), len(model.languages)), np.float32) if whole else None
    back = np.ones((len(sizes), len(model.languages)), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        if t + 1 < len(alive):
            m = int(alive[t + 1])
            back[:m] = (back[:m] * emit[rows[starts[:m] + t + 1]]) @ move.T
            back[:m] /= back[:m].sum(1, keepdims=True)
        found = ahead[offset[t] : offset[t + 1]] * back[:n]
        found /= found.sum(1, keepdims=True)
        total[:n] += found
        certain[:n] += found.max(1)
        if whole:
            every[starts[:n] + t] = found
    mean, certainty = np.empty_like(total), np.empty_like(certain)
    mean[order], certainty[order] = total / sizes[:, None], certain / sizes
    return mean, certainty, every


def train(samples: list[tuple[str, str]], seed: int = 3) -> Model:
    """A model from (language, text) pairs."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    number = {lang: n for n, lang in enumerate(languages)}
    runs: list[tuple[int, list[str]]] = []
    seen = [Counter() for _ in languages]
    for lang, text in samples:
        words = [w for w in words_in(text.lower()) if w.isalpha()]
        seen[number[lang]].update(words)
        at = 0
        while at < len(words):
            size = 1 + int(rng.geometric(1 / RUN))
            runs.append((number[lang], words[at : at + size]))
            at += size
    total = sum(seen, Counter())
    lexicon = {w: n for n, own in enumerate(seen) for w, c in own.items() if total[w] >= LEXICON_COUNT and c >= LEXICON_SHARE * total[w]}
    model = Model(languages, lexicon)
    if len(languages) < 2 or not runs:
        return model
    # Sequences of one length: runs of all languages one after the other, in random order.
    rng.shuffle(runs)
    words = [w for _, run in runs for w in run]
    labels = np.repeat([n for n, _ in runs], [len(run) for _, run in runs])
    if len(words) < SEQUENCE:
        words, labels = words * SEQUENCE, np.tile(labels, SEQUENCE)
    count = len(words) // SEQUENCE
    kinds = sorted(set(words))
    place = {w: i for i, w in enumerate(kinds)}
    token = np.array([place[w] for w in words[: count * SEQUENCE]]).reshape(count, SEQUENCE)
    label = np.asarray(labels[: count * SEQUENCE]).reshape(count, SEQUENCE)
    lists = [features(w, lexicon) for w in kinds]
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    n, size = len(languages), len(model.weights)
    goal = np.stack([np.bincount(token[label == y], minlength=len(kinds)) for y in range(n)], 1)
    goal_move = np.zeros((n, n))
    np.add.at(goal_move, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    goal_begin = np.bincount(label[:, 0], minlength=n)
    params = [model.weights, model.transitions, model.begin]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, PASSES + 1):
        scores = np.add.reduceat(model.weights[flat], starts, axis=0)
        emit = np.exp(scores - scores.max(1, keepdims=True))[token]
        move, begin = np.exp(model.transitions), np.exp(model.begin)
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        alpha[:, 0] = begin * emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, SEQUENCE):
            alpha[:, t] = (alpha[:, t - 1] @ move) * emit[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        moved = np.zeros((n, n))
        for t in range(SEQUENCE - 2, -1, -1):
            coming = beta[:, t + 1] * emit[:, t + 1]
            joint = alpha[:, t, :, None] * move[None] * coming[:, None, :]
            moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta[:, t] = coming @ move.T
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        expected = np.stack([np.bincount(token.ravel(), gamma[:, :, y].ravel(), len(kinds)) for y in range(n)], 1)
        push = goal - expected
        slope = np.stack([np.bincount(flat, np.repeat(push[:, y], sizes), size) for y in range(n)], 1)
        slopes = [slope - RIDGE * model.weights, goal_move - moved - RIDGE * model.transitions, goal_begin - gamma[:, 0].sum(0) - RIDGE * model.begin]
        for p, g, a, b in zip(params, slopes, first, second, strict=True):  # Adam with a falling rate
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            p += 0.25 * (1 - step / (PASSES + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS, letters: int = LETTERS) -> Model:
    """A model from a sample of the labelled rows that are not held out.

    Per language the ``docs_per_language`` rows with the smallest text hash; of each text ``letters`` code points. Spark limits each
    task's share before the shuffle, and the sample that reaches the driver is bounded by these two and the number of languages.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"))
    rows = rows.filter((F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2) & F.col("_lang").isNotNull() & F.col("_t").isNotNull())
    h = row_hash(F.col("_t"))
    start = F.pmod(h, F.greatest(F.length("_t") - letters, F.lit(1))).cast("int") + 1
    rows = rows.select("_lang", h.alias("_h"), F.substring(F.col("_t"), start, F.lit(letters)).alias("_t"))
    rank = Window.partitionBy("_lang").orderBy("_h", "_t")
    sample = rows.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= docs_per_language)
    return train(sorted((r[0], r[1]) for r in sample.select("_lang", "_t").collect()))


def rows_of(model: Model, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Score rows of the words of each text, and the scores."""
    known, scores = worker_state(f"crf {model.name}", lambda: ({}, [np.zeros((0, len(model.languages)), np.float32)]))
    new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        scores[0] = scores[0][:0]
        new = list(dict.fromkeys(w for words in texts for w in words))
    if new:
        found = model.emissions(new)
        blank = np.isnan(found[:, 0])
        for w, at, none in zip(new, range(len(scores[0]), len(scores[0]) + len(new)), blank.tolist(), strict=True):
            known[w] = -1 if none else at
        scores[0] = np.concatenate([scores[0], found])
    out = []
    for words in texts:
        rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        out.append(rows[rows >= 0])
    return out, scores[0]


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("lang_pred", "score"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the columns ``keep`` (not named as an output), and ``outputs`` of every row, without a shuffle.

    lang_pred is ``und`` with score 0 for a text that is null or has no letter, or when nothing was learned; else the language
    with the largest mean probability over all words, which is the score (ties: first by name). ``certainty`` is the mean over the words of
    the probability of each word's own most likely language, high for text in several languages, too. ``spans`` are maximal runs of words of one
    language: first word, end word, language. Repeated rows give repeated results; other columns are not read.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {"lang_pred": "string", "score": "double", "certainty": "double", "spans": "array<struct<first:int,end:int,lang:string>>"}
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    whole = "spans" in outputs

    # The text is sent once: as one of the columns kept, or behind them.
    kept = [c for c in keep if c != "doc_id"]
    names = ["doc_id", *kept]
    at = names.index(text_col) if text_col in kept else len(names)
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, *([] if text_col in kept else [F.col(text_col).alias("_text")]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]] + [f"{o} {types[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            sizes = np.array([len(t.as_py() or "") for t in texts])
            result = [(UNDETERMINED, 0.0, [], 0.0)] * batch.num_rows
            order = np.argsort(-sizes, kind="stable")
            # Texts of like length together, about WORDS words (of five letters and a space) at a time.
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // (6 * WORDS))) + 1
            for part in np.split(order, cuts) if model.languages else []:
                rows, scores = rows_of(model, [words_in((texts[int(i)].as_py() or "").lower()) for i in part])
                used = [(int(i), r) for i, r in zip(part, rows, strict=True) if len(r)]
                if not used:
                    continue
                lengths = np.array([len(r) for _, r in used])
                mean, certainty, every = posteriors(model, np.concatenate([r for _, r in used]), lengths, scores, whole)
                end = 0
                for (i, r), m, c in zip(used, mean, certainty, strict=True):
                    best = int(m.argmax())
                    spans = []
                    if whole:
                        labels = every[end : end + len(r)].argmax(1)
                        end += len(r)
                        edge = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(labels)]
                        spans = [{"first": int(a), "end": int(b), "lang": model.languages[labels[a]]} for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    result[i] = model.languages[best], float(min(m[best], 1.0)), spans, float(min(c, 1.0))
            made = {"lang_pred": pa.array([r[0] for r in result]), "score": pa.array([r[1] for r in result]), "certainty": pa.array([r[3] for r in result]), "spans": pa.array([r[2] for r in result], span_type) if whole else None}
            whole_batch = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(made[o] for o in outputs)], names=[*names, *outputs])
            for start in range(0, batch.num_rows, 512):  # small batches on the way back: texts may be long
                yield whole_batch.slice(start, 512)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the rows that nothing is learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
