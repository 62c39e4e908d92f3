"""Names in several scripts, and surrogates of a whole table against plain Python."""

from __future__ import annotations

import re

import pytest

from signalframe.llm import surrogates
from signalframe.llm.surrogates import KEY, assign, canonical, find_entities, op4_pii_surrogates, pseudonymise, render, surrogate

SF = "/root/testdata/sf0.001"

#: Texts with the names that are to be found in them, and nothing else.
LABELLED = [
    ("Wei Zhang met Mohammed Ali and Aisha Khan", "Wei Zhang Mohammed Ali Aisha Khan"),
    ("Dear Priya Sharma, thanks", "Priya Sharma"),
    ("Dear Priya, thanks", "Priya"),
    ("my name is Ludwig van Beethoven.", "Ludwig Beethoven"),
    ("Je m’appelle Zoé Lefèvre", "Zoé Lefèvre"),
    ("Ich heiße Jürgen Groß", "Jürgen Groß"),
    ("Dear Mr Okonkwo", "Okonkwo"),
    ("Уважаемая Ольга Петрова", "Ольга Петрова"),
    ("Меня зовут Глеб", "Глеб"),
    ("Κυρία Παπαδοπούλου και Γιώργος Παπαδόπουλος", "Παπαδοπούλου Γιώργος Παπαδόπουλος"),
    ("السيد محمد علي قال", "محمد علي"),
    ("السيدة فاطمة الزهراء قالت", "فاطمة الزهراء"),
    ("श्री राहुल शर्मा ने कहा", "राहुल शर्मा"),
    ("גברת שרה כהן אמרה", "שרה כהן"),
    ("王小明先生说，王小明很好。李女士", "王小明 王小明 李"),
    ("我叫张伟。", "张伟"),
    ("Peter Pan In The City Of London opened. The show ran in 1904. In May it closed. Of course The Times wrote.", "Peter Pan"),
]
CLEAN = ["Dear Sir, Dear All, Dear Customers", "In The City Of London", "May I? Of course The Times wrote", "Peter and the wolf", "محمد قال", "他姓王，很好", "Dr. med. is a degree", "دير", ""]


@pytest.mark.parametrize(("text", "names"), LABELLED)
def test_names_by_script(text, names):
    found = find_entities(text)
    assert " ".join(text[a:b] for a, b, _ in found) == names
    for a, b, kind in found:
        made = surrogate(KEY, kind, canonical(kind, text[a:b]))
        assert surrogates.script(made) == surrogates.script(text[a:b])
        assert render(kind, text[a:b], made)[0].isupper() == text[a].isupper()


@pytest.mark.parametrize("text", CLEAN)
def test_sentence_words_are_no_names(text):
    assert find_entities(text) == []


def test_letters_keep_their_script():
    for name in ("παπαδόπουλος", "иванов", "حسن", "כהן", "शर्मा", "王明", "ひらがな", "한글"):
        made = surrogate(KEY, "password", name)
        assert surrogates.script(made) == surrogates.script(name) and len(made) == len(name)


def brute(texts, key):
    """Surrogates of a table: entities of all texts, and one dictionary for each space."""
    entities = {(k, canonical(k, t[a:b])) for t in texts if t for a, b, k in find_entities(t)}
    space = {kind: re.sub("^(given|full)_.*", r"\1", kind) for kind, _ in entities}
    taken, made = {(space[k], n) for k, n in entities}, {}
    attempt, trying = 0, sorted(entities)
    while trying:
        later = []
        for kind, name in trying:
            new = surrogate(key, kind, name, attempt)
            if (space[kind], new) in taken:
                later.append((kind, name))
            else:
                made[kind, name] = new
                taken.add((space[kind], new))
        trying, attempt = later, attempt + 1
    assert len({(space[k], m) for (k, _), m in made.items()}) == len(entities)
    out = []
    for t in texts:
        parts, at = [], 0
        for a, b, kind in find_entities(t or ""):
            parts += [t[at:a], render(kind, t[a:b], made[kind, canonical(kind, t[a:b])])]
            at = b
        out.append("".join(parts) + t[at:] if parts else t)
    return out


def test_whole_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], KEY), strict=True))
    assert {r.doc_id: r.text for r in op4_pii_surrogates(spark, SF).collect()} == wanted


def test_names_of_a_table_against_brute_force(spark):
    texts = [t for t, _ in LABELLED] + [f"Dear {n} {m}" for n in surrogates.GENDER for m in ("Smith", "Jones")] + [None, "", "Dear Wei Zhang " * 3000]
    found = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").collect()
    assert [r.text for r in sorted(found, key=lambda r: r.doc_id)] == brute(texts, b"k")
    assert found and all(r.n_entities == len(find_entities(t or "")) for r, t in zip(sorted(found, key=lambda r: r.doc_id), texts, strict=True))


def test_one_draw_shared_by_many(spark, monkeypatch):
    """Every listed name used up at once: no row number over those who drew the same, and all stay different."""
    names = [("given_f", f"name{i}") for i in range(3000)] + [("given_m", f"name{i}") for i in range(2000)]
    made = assign(spark.createDataFrame(names + names[:500], "kind string, name string"), b"k")
    rows = made.collect()
    assert len(rows) == 5000 == len({r.made for r in rows}) and "Window" not in made._jdf.queryExecution().toString()
    assert all(re.fullmatch(r"[a-z]+(-[a-z]+)?", r.made) for r in rows)


def test_odd_rows_keep_their_names(spark):
    rows = [(None, "Dear Anna Schmidt", "x"), (None, "Dear Anna Schmidt", "x"), (1, None, None), (1, "Dear Anna Schmidt", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, made string").selectExpr("*", "made as space", "made as _w", "made as attempt")
    found = pseudonymise(df, b"k").collect()
    assert len(found) == 4 and len({r.text for r in found if r.text}) == 1 and not any("Schmidt" in (r.text or "") for r in found)
