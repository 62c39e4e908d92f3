"""PII: keyed surrogates instead of personal data.

Entities (mail and network addresses, phone, card, account and social numbers, secrets, personal names) are found in whole
texts. Each gets a replacement of its own kind made from HMAC-SHA256 of a key: same length and punctuation, digits for
digits, letters for letters of the same script and case, a valid check digit where there was one, a given name of the same gender. The
replacement depends on the key and the entity's canonical form only, so an entity is renamed alike in every
document and spelling (coreference).

Names begin with a title, words that introduce a name ("Dear", "my name is") or a listed given name, and take the capitalised
words that follow, over particles (van, de), up to the first function word. Arabic, Hebrew and Devanagari have no capitals: there a
title takes the next two words and all listed given names after them, and a listed given name only further listed ones. A
Chinese name is a listed surname and up to two characters before a title or after introducing words. Once a text has a name, all
further mentions of its words in that text are replaced too. Names without any of these are not found.

Collision checks run on the table of different entities: of those that would get the same replacement, or one that is itself an
entity of the corpus, all but the first try again until none collide (distinctness).
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table
from signalframe.session import durable, ship_package

KEY = b"surrogates of the example query"

# Common given names by gender and script, titles by gender, in natural order.
GIVEN = {
    ("f", "latin"): "Aisha Alice Amelia Anna Beatriz Camille Carmen Charlotte Clara Elena Elisabeth Emily Emma Fatima Hannah Helene Ines Isabel Julia Laura Lucia Marie Martina Mary Mei Monika Nadine Olivia Paula Petra Priya Sarah Sofia Susan Yuki".split(),
    ("m", "latin"): "Ahmed Alexander Andreas Antoine Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henri Henry Hiroshi Jacques James Javier John Juan Lucas Luis Martin Michael Mohammed Omar Pablo Paul Peter Pierre Rahul Robert Thomas Wei".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
    ("f", "arabic"): "زينب عائشة فاطمة ليلى مريم نور".split(),
    ("m", "arabic"): "أحمد حسن خالد علي عمر محمد يوسف".split(),
    ("f", "hebrew"): "מרים רחל שרה תמר".split(),
    ("m", "hebrew"): "אברהם דוד יוסף משה".split(),
    ("f", "devanagari"): "अनीता प्रिया मीरा सुनीता".split(),
    ("m", "devanagari"): "अमित राजेश राहुल विजय".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία السيدة גברת श्रीमती".split(),
    "m": "Mr Herr Monsieur Señor Sr Don Господин Κύριος Κύριε السيد מר श्री".split(),
    "": "Dr Prof".split(),
}
# Words that introduce a name, by gender.
INTRODUCED = {
    "f": ["Chère", "Estimada", "Уважаемая", "Αγαπητή"],
    "m": ["Cher", "Estimado", "Уважаемый", "Αγαπητέ"],
    "": ["Dear", "[Mm]y name is", "[Ii]ch heiße", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Мм]еня зовут", "[Μμ]ε λένε", "اسمي", "שמי", "मेरा नाम"],
}
# Function words, and words that letters are addressed to, which no name goes on with.
NO_NAME = set(
    "about after all and are as at because before but by could did does for from has have he her his how if in into is it its not of on or our over she should that the their these they this those to under was we were what when where which who why with would you your"
    " customer customers colleague colleagues editor everyone friend friends madam members reader readers sir sirs students team"
    " aber auf aus bei das die ein eine für ihr im ist mit nach nicht oder sie und war wie wir zu"
    " avec dans elle est et il nous ou pour sont sur une vous con cuando ella en es ese esta las los para pero por pues que una"
    " была был его как на не но он она от по что και με να στη στο την της του"
    " إلى الذي على في قال قالت من هذا هو هي אמר אמרה הוא היא לא על של את और का की के को ने में से है हैं".split()
)
PARTICLES = "van von der den de del della di da dos du la le bin ibn al el y zu".split()
# Common Chinese surnames, characters of given names by gender, and titles by gender.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓冯韩曹"
HAN_NAMES = {"f": "芳丽娜静敏秀玲燕雪婷梅琳慧莹兰霞", "m": "伟强军明杰勇磊涛刚超辉鹏华建国平"}
HAN_TITLES = {"f": ["女士", "小姐", "太太"], "m": ["先生"], "": ["教授", "博士", "医生", "老师"]}
#: Characters of scripts other than Latin, and their small letters.
SCRIPTS = {
    "cyrillic": "[Ѐ-ӿ]", "greek": "[Ͱ-Ͽἀ-῿]", "arabic": "[؀-ۿ]", "hebrew": "[֐-׿]", "devanagari": "[ऀ-ॿ]", "han": "[一-鿿]", "kana": "[ぁ-ヿ]", "hangul": "[가-힣]",
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "".join(map(chr, range(ord("а"), ord("я") + 1))),
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "devanagari": "".join(map(chr, range(ord("क"), ord("ह") + 1))),
    "han": HAN_NAMES["f"] + HAN_NAMES["m"],
    "kana": "".join(map(chr, range(ord("か"), ord("ち")))),
    "hangul": "".join(chr(ord("가") + 28 * n) for n in range(256)),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па ре ро са се со та те то".split(),
    "greek": [c + v for c in "βγδκλμνπρτ" for v in "αεο"],
    "arabic": [c + v for c in "بتجدرسفكلمن" for v in "اوي"],
    "hebrew": [c + v for c in "בגדזלמנפרשת" for v in "איו"],
    "devanagari": [c + v for c in "कगतदनपमरलसव" for v in "ािे"],
}
#: What names made of syllables end in: surnames, female and male given names.
ENDINGS = {
    "latin": ("n", "na", "r"), "cyrillic": ("н", "на", "р"), "greek": ("σ", "να", "σ"), "arabic": ("ن", "ة", "ر"), "hebrew": ("ן", "ה", "ל"), "devanagari": ("न", "नी", "र"),
}
_caseless = ("arabic", "hebrew", "devanagari")

GENDER = {name: g for (g, _), names in GIVEN.items() for name in names}
LISTED = {name.casefold(): g for name, g in GENDER.items()}
TITLE = {t: g for g, titles in TITLES.items() for t in titles}
# Combining marks belong to the letter before them.
_marks = "\u0300-\u036f\u064b-\u0652\u0900-\u0903\u093a-\u094f"
_letter = rf"[^\W\d_][{_marks}]*"
_word = rf"(?:{_letter})+(?:[-'’](?:{_letter})+)*"
_no_more = rf"(?![\w{_marks}])"
_introduced = [rf"(?:{p}){_no_more}" for of in INTRODUCED.values() for p in of]
_title = rf"(?:{'|'.join(TITLE)})\.?[ \t]+"
#: What a name begins with: introducing words, titles, or a listed given name (or two, hyphenated) before another word.
HEAD = re.compile(
    rf"\b(?:(?=[^\Wa-z\d_])(?<![{_marks}])(?:(?P<title>(?:{_title})+)|(?P<given>(?:{'|'.join(GENDER)})(?:-(?:{_letter})+)*(?=[ \t])))"
    rf"|(?=[^\Wa-hk-lo-z\d_])(?<![{_marks}])(?P<lead>(?:{'|'.join(_introduced)})[ \t]+(?P<named>(?:{_title})*)))"
)
_introduces = [(re.compile(p), g) for g, of in INTRODUCED.items() for p in of]
_words = re.compile(_word)
_letters = re.compile(rf"(?:{_letter})+")
#: Before the next word of a name; an initial has a full stop.
_gap = re.compile(rf"(?:[ \t]+|(?<=\b[^\W\d_])\.[ \t]+)(?:(?:{'|'.join(PARTICLES)})[ \t]+)*")
_han_title = "|".join(t for of in HAN_TITLES.values() for t in of)
HAN = re.compile(rf"[{SURNAMES}][一-鿿]{{0,2}}?(?={_han_title})|(?:(?<=我叫)|(?<=我的名字是)|(?<=姓名：))[{SURNAMES}][一-鿿]{{1,2}}(?![一-鿿])")
PATTERNS = {
    "email": r"[\w.%+-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|[0-9a-fA-F]{32,})(?![A-Za-z0-9])",
    "password": r"(?i:(?<=password=)|(?<=passwd=)|(?<=pwd=)|(?<=password: )|(?<=secret=)|(?<=token=))[^\s\"'|,;]{4,}",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ .-]?\d){4,13}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
}
#: What each kind's pattern cannot match without. A kind is left out of a text that has none of it, which changes no match.
NEEDS = {
    "email": r"@",
    "secret": PATTERNS["secret"],
    "password": r"=(?i:(?<=password=)|(?<=passwd=)|(?<=pwd=)|(?<=secret=)|(?<=token=))|: (?i:(?<=password: ))",
    "mac": r"[:-][0-9A-Fa-f]{2}[:-]",
    "iban": r"[A-Z]{2}\d{2}",
    "ip": r"\.\d{1,3}\.\d{1,3}\.\d",
    "ssn": r"-\d{2}-\d{4}",
    "card": r"\d{4}[ -]?\d{4}",
    "phone": r"\+\d|\(\d{2}|[.-]\d{3}[.-]\d{4}",
}
_needs = [(k, re.compile(p).search) for k, p in NEEDS.items()]
_digit_kinds = {"card", "phone", "ssn"}


@cache
def any_of(kinds: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in PATTERNS if k in kinds))


def canonical(kind: str, surface: str) -> str:
    if kind in _digit_kinds:
        return "".join(filter(str.isdigit, surface))
    if kind == "iban":
        return surface.replace(" ", "")
    if kind in ("email", "mac", "last") or kind.startswith("given_"):
        return surface.casefold()
    return surface


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the entities of a text, in order, not overlapping."""
    kinds = tuple(k for k, needed in _needs if needed(text))
    found = [(m.start(), m.end(), m.lastgroup) for m in any_of(kinds).finditer(text)] if kinds else []
    found += names_in(text)
    if not text.isascii():
        found += han_names_in(text)
    found.sort()
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return with_mentions(text, out)


def script(text: str) -> str:
    """The script of the first character that is not Latin."""
    return "latin" if text.isascii() else next((name for name, chars in _scripts if chars.search(text)), "latin")


_scripts = [(name, re.compile(chars)) for name, chars in SCRIPTS.items()]


def name_word(text: str, at: int) -> int:
    """End of the word at ``at`` that may be a name's, without a possessive s; ``at`` if there is none."""
    m = _words.match(text, at)
    if not m or re.match(r"\w", text[m.end() : m.end() + 1]) or m[0].casefold() in NO_NAME:
        return at
    if not m[0][0].isupper() and script(m[0]) not in _caseless:
        return at
    return m.end() - 2 if len(m[0]) > 2 and m[0][-2:] in ("'s", "’s") else m.end()


def names_in(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the words of names that begin as ``HEAD`` says.

    The last word is the surname; the others are given names, of the gender they are listed with, else of the title, the introducing
    words or the first name. A single word is a surname after a title, a given name after introducing words.
    """
    found: list[tuple[int, int, str]] = []
    m = HEAD.search(text)
    while m:
        at, words, titles = m.end(), [], m["title"] or m["named"] or ""
        if m["given"]:
            gender = GENDER[m["given"].partition("-")[0]]
            words.append(m.span())
            at = _gap.match(text, at).end()
        else:
            gender = next((TITLE[t] for t in re.findall(rf"[\w{_marks}]+", titles) if TITLE[t]), "")
            if not gender and m["lead"]:
                gender = next(g for p, g in _introduces if p.match(m["lead"]))
        while (end := name_word(text, at)) > at:
            more = not text[at].isupper() and text[at:end] not in GENDER
            if more and (m["given"] or len(words) > 1):
                break
            words.append((at, end))
            gap = _gap.match(text, end)
            if not gap:
                break
            at = gap.end()
        if len(words) > bool(m["given"]):
            single = len(words) == 1 and not titles
            found += [(a, b, f"given_{LISTED.get(text[a:b].casefold(), gender)}") for a, b in (words if single else words[:-1])]
            found += [] if single else [(*words[-1], "last")]
        m = HEAD.search(text, max(m.end(), words[-1][1] if words else 0))
    return found


def han_names_in(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of Chinese names, and of every other mention of those of two and more characters."""
    kinds: dict[str, str] = {}
    found = []
    for m in HAN.finditer(text):
        gender = next((g for g, of in HAN_TITLES.items() if text.startswith(tuple(of), m.end())), "")
        kind = kinds.setdefault(m[0], f"full_{gender}")
        found.append((*m.span(), kind))
    longer = sorted((n for n in kinds if len(n) > 1), key=len, reverse=True)
    if longer:
        found += [(*m.span(), kinds[m[0]]) for m in re.finditer("|".join(longer), text)]
    return sorted(set(found))


def with_mentions(text: str, entities: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The entities, and every other whole-word mention of their names in the text. A word has one kind throughout a text.

    A word that is both given name and surname is what the list of given names says, and a surname if it is not listed.
    """
    kinds: dict[str, str] = {}
    for a, b, kind in entities:
        if kind == "last" or kind.startswith("given_"):
            name = canonical(kind, text[a:b])
            held = kinds.setdefault(name, kind)
            if (held == "last") != (kind == "last"):
                kinds[name] = "last" if name not in LISTED else f"given_{LISTED[name]}"
    if not kinds:
        return entities
    out, after, begins = [], 0, [e[0] for e in entities] + [len(text)]
    for n in range(len(begins)):
        for m in _words.finditer(text, after, begins[n]):
            whole = m[0].casefold() in kinds
            for a, b in [m.span()] if whole else [p.span() for p in _letters.finditer(text, *m.span())]:
                name = text[a:b].casefold()
                alone = not re.match(r"\w", text[b : b + 1]) and not re.match(r"\w", text[a - 1 : a] if a else "")
                if name in kinds and (text[a].isupper() or script(name) in _caseless) and alone:
                    out.append((a, b, kinds[name]))
        if n < len(entities):
            a, after, kind = entities[n]
            out.append((a, after, kinds.get(canonical(kind, text[a:after]), kind) if kind == "last" or kind.startswith("given_") else kind))
    return out


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


#: After so many attempts a format counts as used up and the replacement gets a character more.
GROW = 6


def surrogate(key: bytes, kind: str, name: str, attempt: int = 0) -> str:
    """The canonical form of the replacement of an entity's canonical form ``name``."""
    more = attempt // GROW

    def numbers(*what: object) -> Iterator[int]:
        seed = repr((kind, *what)).encode()
        return chain.from_iterable(hmac.digest(key, seed + b"/%d" % n, "sha256") for n in range(1 << 30))

    def alike(text: str, source: Iterator[int]) -> str:
        out = []
        for c, n in zip(text, source, strict=False):
            if c.isdigit():
                out.append(str(n % 10))
            elif c.isalpha():
                letters = LETTERS[script(c)]
                made = letters[n % len(letters)]
                out.append(made.upper() if c.isupper() else made)
            else:
                out.append(c)
        return "".join(out)

    source = numbers(name, attempt)
    if kind == "email":
        local, _, domain = name.partition("@")
        if domain == "example.com" or domain.endswith(".example.com"):
            host = alike(domain.removesuffix("example.com"), numbers("domain", domain)) + "example.com"
        else:
            host = alike(domain.rpartition(".")[0], numbers("domain", domain)) + ".example"
        return f"{alike(local + 'a' * more, source)}@{host}"
    if kind == "ip":
        parts = name.split(".")
        fixed = 0 if more else 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or parts[0] == "172" and 16 <= int(parts[1]) < 32 else 0
        rest = [str(1 + n % 254) for n, _ in zip(source, parts[fixed:], strict=False)]
        return ".".join(parts[:fixed] + rest)
    if kind == "card":
        made = name[0] + alike(name[1:] + "0" * more, source)
        return made[:-1] + str((int(made[-1]) - luhn(made)) % 10) if luhn(name) == 0 else made
    if kind == "phone":
        return name[0] + alike(name[1:] + "0" * more, source)
    if kind == "iban":
        body = alike(name[4:], source)
        value = "".join(str(int(c, 36)) for c in body + name[:2] + "00")
        return f"{name[:2]}{98 - int(value) % 97:02d}{body}"
    if kind in ("mac", "secret") and re.fullmatch("[0-9a-fA-F:-]+", name):
        return "".join(c if c in ":-" else ("0123456789ABCDEF" if name.upper() == name else "0123456789abcdef")[n % 16] for c, n in zip(name, source, strict=False))
    if kind == "secret":
        head = 4 if name.startswith("AKIA") else max(name.find("-"), name.find("_")) + 1
        return name[:head] + alike(name[head:] + "a" * more, source)
    style = script(name)
    if kind.startswith("full_"):
        own = HAN_NAMES.get(kind[-1], LETTERS["han"])
        rest = range(len(name) - 1 + attempt // 2)
        return SURNAMES[next(source) % len(SURNAMES)] + "".join(own[n % len(own)] for n, _ in zip(source, rest, strict=False))
    if kind.startswith("given_"):
        gender = kind[-1] if kind[-1] in "fm" else "fm"[next(source) % 2]
        names = [x.casefold() for x in GIVEN.get((gender, style), GIVEN[gender, "latin"])]
        n = next(source)
        if attempt == 0:
            return names[(n << 8 | next(source)) % len(names)]
        if attempt == 1:
            return names[n % len(names)] + "-" + names[(next(source) << 8 | next(source)) % len(names)]
    if kind == "last" or kind.startswith("given_"):
        style = style if style in SYLLABLES else "latin"
        parts, ending = SYLLABLES[style], ENDINGS[style][0 if kind == "last" else 1 + (gender == "m")]
        return "".join(parts[n % len(parts)] for n, _ in zip(source, range(3 + attempt // 4), strict=False)) + ending
    return alike(name + ("0" if kind == "ssn" else "a") * more, source)


def render(kind: str, surface: str, made: str) -> str:
    """The replacement in the format and case of ``surface``."""
    if kind in _digit_kinds:
        digits = iter(made)
        return "".join(next(digits) if c.isdigit() else c for c in surface) + "".join(digits)
    if kind == "iban" and " " in surface:
        return " ".join(made[i : i + 4] for i in range(0, len(made), 4))
    if kind in ("email", "mac"):
        return made.upper() if surface.isupper() else made
    if kind == "last" or kind.startswith("given_"):
        if surface.isupper() and len(surface) > 1:
            return made.upper()
        return re.sub(r"σ\b", "ς", made.title())
    return made


def mentions(rows: DataFrame) -> DataFrame:
    """Different (_id, _h, kind, name) of rows with _id, _h and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, names = [], [], []
            for i, t in enumerate(batch.column(2)):
                text = t.as_py() or ""
                for kind, name in sorted({(k, canonical(k, text[a:b])) for a, b, k in find_entities(text)}):
                    at.append(i), kinds.append(kind), names.append(name)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["_id", "_h", "kind", "name"])

    kind = dict(rows.dtypes)["_id"]
    return rows.select("_id", "_h", "text").mapInArrow(run, f"_id {kind}, _h long, kind string, name string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, name, made) for rows (kind, name): different replacements, none of which is an entity's name.

    Given names of either gender, and of none, share one space. In each round the first of those who drew the same replacement, by
    kind and name, keeps it unless it is taken; the others draw again. Who drew the same never meets in one task: the first is
    found by an aggregate, and told by a join on kind and name. The loop ends when nobody has to try again.
    """

    @F.pandas_udf("string")
    def make(kind, name, attempt):
        return kind.combine(name, lambda k, n: (k, n)).combine(attempt, lambda kn, a: surrogate(key, kn[0], kn[1], int(a)))

    space = F.when(F.col("kind").rlike("^(given|full)_"), F.substring_index("kind", "_", 1)).otherwise(F.col("kind"))
    named = durable(entities.select("kind", "name").distinct().withColumn("space", space))
    taken = named.select("space", F.col("name").alias("made"))
    settled, trying, attempt = None, named, 0
    while True:
        drawn = durable(trying.withColumn("made", make("kind", "name", F.lit(attempt))))
        first = drawn.groupBy("space", "made").agg(F.min(F.struct("kind", "name")).alias("_w"))
        won = durable(first.join(taken, ["space", "made"], "left_anti").select("space", "made", "_w.kind", "_w.name"))
        settled = won if settled is None else settled.unionByName(won)
        trying = durable(trying.join(won, ["kind", "name"], "left_anti"))
        if trying.isEmpty():
            return settled.select("kind", "name", "made")
        taken, attempt = taken.unionByName(won.select("space", "made")), attempt + 1


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_entities (mentions), kinds (sorted, different) and text with surrogates, of every row.

    Null texts stay null and texts without entities stay as they are. Equal rows get equal results, a null id
    stays null, an empty table gives an empty result; other columns, of any name, are not read. Texts of any length are read whole.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), row_hash(F.col(text_col)).alias("_h"), F.col(text_col).alias("text"))
    found = durable(mentions(rows))
    given = found.join(assign(found, key), ["kind", "name"])
    renamed = given.groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_set(F.struct("kind", "name", "made")).alias("renamed"))
    joined = rows.join(renamed, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kinds, texts = [], [], []
            for t, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                entities = find_entities(t) if names else []
                made = {(n["kind"], n["name"]): n["made"] for n in names or []}
                out, at = [], 0
                for a, b, kind in entities:
                    out += [t[at:a], render(kind, t[a:b], made[kind, canonical(kind, t[a:b])])]
                    at = b
                texts.append("".join(out) + t[at:] if entities else t)
                counts.append(len(entities))
                kinds.append(sorted({k for _, _, k in entities}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "kinds", "text"])

    kind = dict(docs.dtypes)[id_col]
    return joined.select("_id", "text", "renamed").mapInArrow(run, f"doc_id {kind}, n_entities long, kinds array<string>, text string")


def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(table(spark, folder, "documents"), KEY)
