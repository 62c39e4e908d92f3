"""Cross-tokenizer alignment against whole texts tokenized by the libraries."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalframe.llm import token_align
from signalframe.llm.token_align import Links, Pair, align, alignments, op13_token_align, vocabulary_paths

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
LETTER = token_align.byte_letters()


@pytest.fixture(scope="module")
def pair():
    a, b = vocabulary_paths()
    return Pair(open(a, encoding="utf-8").read(), open(b, "rb").read())


@pytest.fixture(scope="module")
def library():
    a, b = vocabulary_paths()
    one = tokenizers.Tokenizer.from_file(a)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=b)


def groups(library, text):
    """Groups of (A ids, B ids) from the decoded bytes of the whole text."""
    one, two = library
    a = one.encode(" " + text, add_special_tokens=False).ids if text else []
    b = two.encode(text) if text else []
    ab = [bytes(LETTER[c] for c in one.id_to_token(i)) for i in a]
    bb = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return []
    ends = lambda parts: [sum(map(len, parts[: n + 1])) for n in range(len(parts))] if len(parts) < 500 else running(parts)
    ea, eb = ends(ab), ends(bb)
    out, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        x, y = i, j
        while i < len(ea) and ea[i] <= cut:
            i += 1
        while j < len(eb) and eb[j] <= cut:
            j += 1
        out.append((tuple(a[x:i]), tuple(b[y:j])))
    return out


def running(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def as_text(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


def expected(library, docs):
    made = [(i, groups(library, t or "")) for i, t in docs]
    holders = Counter()
    for _, found in made:
        holders.update({(a, b) for x, y in found for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    rows = []
    for i, found in made:
        links = [(a, b) for x, y in found for a in x for b in y]
        rows.append((
            i, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links),
            sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(as_text(found).encode()).hexdigest() if found else "",
        ))
    return sorted(rows, key=repr)


STRANGE = ["é 漢字 😀x\n a\x00b <0x41> <s> <|endoftext|> q  z", "\u2581", "a \u2581 b", " lead", "trail \n", "  ", "\n\n x\t y \u3000 z\u00a0 w\u2003 v\x85 u\x1c t", "ÄÖ" * 90, "😀🤦🏽‍♂️ " * 9, "don't I'LL 'S 12 345,6", "ﷺ ﬁ Å"]


@pytest.mark.parametrize("text", STRANGE)
def test_units_say_what_whole_texts_say(pair, library, text):
    check(pair, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tab'é漢😀\u2581")), max_size=40))
def test_units_of_any_text(pair, library, text):
    check(pair, library, text)


def check(pair, library, text):
    found = Links()
    for unit in pair.units(" " + text) if text else []:
        align(pair, [unit], found)
    texts = [] if None in found.texts else found.texts
    assert ";".join(texts) == as_text(groups(library, text))


def test_batches_of_units(pair, library):
    """Many units at once, one of them without tokens, give what each gives alone."""
    units = [" the", " é漢", " \u2581x", " 😀", " of"] * 3
    together, alone = Links(), Links()
    align(pair, units, together)
    for u in units:
        align(pair, [u], alone)
    for one, other in ((together.counts, alone.counts), (together.codes, alone.codes), (together.repeats, alone.repeats)):
        assert np.concatenate(one).tolist() == np.concatenate(other).tolist()
    assert together.texts == alone.texts and together.texts[2] is None


def test_coarse_cuts_are_refined(pair):
    """A token inside a character ends where its bytes end, not where the character does."""
    raw, a, a_end, b, b_end = pair.spans(" 漢\u0915")
    assert raw == " 漢\u0915".encode() and a_end[-1] == b_end[-1] == len(raw)
    assert len(set(a_end.tolist())) == len(a) and len(set(b_end.tolist())) == len(b)


@pytest.mark.parametrize("chunk", [1 << 23, 3000])
def test_chunks(library, pair, chunk):
    """Chunks of one worker, with what it remembers, by plain sums over their pairs."""
    texts = [t.encode() for t in STRANGE * 3 + ["one two, three", "", "two three one"]]
    memory = token_align.Memory()
    for start in range(0, len(texts), 7):
        part = texts[start : start + 7]
        row = token_align.chunk_row(pair, memory, list(range(len(part))), part)
        found = [groups(library, t.decode()) for t in part]
        assert [r[0] for r in row["sums"].reshape(-1, 4).tolist()] == [sum(len(x) for x, _ in f) for f in found]
        held = Counter(p for f in found for p in {a << 32 | b for x, y in f for a in x for b in y})
        assert dict(zip(row["codes"].tolist(), row["docs"].tolist(), strict=True)) == held
        if chunk == 3000:
            memory.clear()


def test_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_token_align(spark, folder).collect()), key=repr) == expected(library, docs)


def test_odd_rows(spark, odd, plain_odd, none, library):
    docs = [(i, t) for i, t, *_ in plain_odd] + [(100 + n, t) for n, t in enumerate(STRANGE)]
    more = spark.createDataFrame(docs[len(plain_odd) :], "doc_id long, text string")
    df = odd.withColumns({c: odd["doc_id"] for c in ("chunk", "codes", "code", "n", "best", "n_a")}).unionByName(more, allowMissingColumns=True)
    assert sorted((tuple(r) for r in alignments(df).collect()), key=repr) == expected(library, docs)
    assert alignments(none).collect() == []
