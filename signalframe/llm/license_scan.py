"""License scans by conditional compression.

Blocks around license words are compressed alone and once more with each template as a raw zstandard dictionary. The bytes
that this takes off a block rank the pairs of block and template, and the pairs are walked in that order, the largest reduction
first. The first whose wording is confirmed wins and ends the walk: the exact differences between the template's words and the
block's are few, none is in a word that tells licenses apart (names, version numbers), and the license word is covered.
Templates that save nothing are not walked. Row by row, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import table
from signalframe.session import ship_package

# Public license texts and the usual short notices, by SPDX id.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."),
    ("all-rights-reserved", "All rights reserved."),
]
# Ids of further licenses that SPDX lines name often.
OTHER_IDS = """0BSD AFL-3.0 Artistic-2.0 BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0
EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-1.0 LGPL-2.0 MIT-0 MS-PL MS-RL MPL-1.1 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby
Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
#: Words that tell licenses apart; a difference in one of them, or in a word with a digit, rules a template out.
TELLING = set("apache mit isc gnu general lesser affero public bsd clause mozilla mpl creative commons cc by nc sa nd attribution noncommercial sharealike cc0 gpl lgpl agpl not no except".split())
#: A winner differs in at most this share of its template's words (one word at least).
DIFFERENT = 0.15
#: Words of a block before and after its license words, besides those of the templates.
AROUND = 8

_cue = re.compile(r"(?i)licen[sc]e|copyright|permission is hereby|redistribut|permission to use|rights reserved|free software|\bspdx\b|public domain|creative commons|mozilla")
_hints = ("licen", "opyright", "OPYRIGHT", "LICEN", "Licen", "ermission", "edistribut", "eserved", "ESERVED", "ree software", "SPDX", "ublic domain", "ommons", "ozilla")
_word = re.compile(r"\w+(?:[.-]\w+)*")
_id = r"[A-Za-z0-9](?:[\w.+:-]*[\w+])?"
#: An SPDX line names its licenses itself: ids joined by AND and OR; WITH is followed by an exception.
_spdx = re.compile(rf"(?i:SPDX-License-Identifier):[ \t(]*{_id}(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+{_id})*")
_spdx_id = re.compile(rf"(?:[: \t(])(?!AND |OR |WITH )(?<!WITH )({_id})")
_version = re.compile(r"(?i)\b(?:version|ver|v)[.:]?\s*$")


def words_of(text: str, begin: int, end: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Places and lower-case words of a stretch; the number of a list item ends in a full stop, so that it isn't a version."""
    spans, words = [], []
    for m in _word.finditer(text, begin, end):
        a, b = m.span()
        word = m[0].lower()
        if b - a < 3 and word.isdigit() and text[b : b + 1] in (".", ")") and text[b + 1 : b + 2].isspace():
            before = text[max(0, a - 40) : a]
            if re.search(r"(?:^|[.:;]|\n)[\s*#/;>(-]*$", before) and not _version.search(before):
                word += "."
        spans.append((a, b))
        words.append(word)
    return spans, words


@cache
def known_ids() -> dict[str, str]:
    """SPDX ids that a line may name, by lower case: those of the templates, of the GNU family with its suffixes, and OTHER_IDS."""
    ids = {spdx for spdx, _ in TEMPLATES if spdx != "all-rights-reserved"} | set(OTHER_IDS)
    gnu = [i for i in ids if re.match(r"(?:L|A)?GPL-|GFDL-", i)]
    return {i.lower(): i for i in [*ids, *(f"{g}{end}" for g in gnu for end in ("-only", "-or-later", "+"))]}


def spdx_line(text: str, line: re.Match[str]) -> list[tuple[str, int, int, float | None, list[str], int]]:
    """The licenses of an SPDX line; the first one's place begins with the line. An id that isn't known is ``unknown``, with the id as difference."""
    found = []
    for n, m in enumerate(_spdx_id.finditer(text, line.start() + len("SPDX-License-Identifier"), line.end())):
        known = known_ids().get(m[1].lower())
        found.append((known or "unknown", line.start() if n == 0 else m.start(1), m.end(1), None, [] if known else ["+" + m[1]], 0))
    return found


@cache
def templates() -> list[tuple[str, str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for spdx, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((spdx, text, words_of(text, 0, len(text))[1], zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False)))
    return out


@cache
def reach() -> int:
    """Words before a license word that a block needs: the most that any template has before one of its own, and AROUND more."""
    return AROUND + max(len(_word.findall(text, 0, m.start())) for _, text, _, _ in templates() for m in _cue.finditer(text))


def tells(word: str) -> bool:
    return any(c.isdigit() for c in word) and word[-1] != "." or not TELLING.isdisjoint(re.split("[.-]", word))


@cache
def needed() -> list[tuple[frozenset[str], frozenset[str], float]]:
    """Of each template the words that rule it out when missing, all words, and how many differences it may have."""
    return [(frozenset(filter(tells, words)), frozenset(words), max(1, DIFFERENT * len(words))) for _, _, words, _ in templates()]


@cache
def alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


def candidate_blocks(text: str, cue: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) around a license word: its line, a few words, and as many as the longest template has.

    Short notices drown in what surrounds them, so the line comes without words before it.
    """
    longest = max(len(t[2]) for t in templates())
    # Looked for in ever more characters before the cue, until there are enough words.
    wide = 16 * reach()
    while len(before := [m.start() for m in _word.finditer(text, max(0, cue - wide), cue)]) <= reach() and wide < cue:
        wide *= 4
    before = before[-reach() :]
    ends, end = [], cue
    for n, m in enumerate(_word.finditer(text, cue), 1):
        end = m.end()
        if n in (2 * AROUND, longest + AROUND):
            ends.append(end)
        if n >= longest + AROUND:
            break
    begins = [before[-AROUND:][0], before[0]] if before else [cue]
    line = max(begins[-1], text.rfind("\n", begins[-1], cue) + 1)
    stop = text.find("\n", cue, ends[0] if ends else end)
    return list(dict.fromkeys([(line, stop if stop > 0 else (ends or [end])[0]), *((b, e) for b in begins for e in [*ends, end])]))


def difference(ours: list[str], theirs: list[str]) -> tuple[int, int, list[str]]:
    """First and end word of ``ours`` that a template stands for, and the wording differences inside."""
    match = SequenceMatcher(None, ours, theirs, autojunk=False)
    parts = [m for m in match.get_matching_blocks() if m.size]
    if not parts:
        return 0, 0, ["-" + w for w in theirs]
    first, end = parts[0].a, parts[-1].a + parts[-1].size
    diff = []
    for op, a0, a1, b0, b1 in SequenceMatcher(None, ours[first:end], theirs, autojunk=False).get_opcodes():
        if op != "equal":
            diff += ["-" + w for w in theirs[b0:b1]] + ["+" + w for w in ours[first + a0 : first + a1]]
    return first, end, diff


def confirmed(words: list[str], spans: list[tuple[int, int]], template: int, cue: int) -> tuple[int, int, list[str]] | None:
    """Begin, end and wording differences of a template in a block's words; None where they differ too much or pass by the license word."""
    telling, every, most = needed()[template]
    present = set(words)
    if not telling <= present or len(every - present) > most:
        return None  # the comparison would say the same
    first, last, diff = difference(words, templates()[template][2])
    # What doesn't cover the license word has one of its own; it must not hide a notice before it.
    if len(diff) > most or any(tells(d[1:]) for d in diff) or not spans[first][0] <= cue < spans[last - 1][1]:
        return None
    return spans[first][0], spans[last - 1][1], diff


def walk_text(text: str) -> list[tuple[str, int, int, float | None, list[str], int]]:
    """Licenses of a text in order: SPDX id, begin, end, share saved, wording differences, place of the winner in the walk.

    SPDX lines name their licenses: nothing is saved (null) and no walk is made (place 0).
    """
    found: list[tuple[str, int, int, float | None, list[str], int]] = []
    if not any(h in text for h in _hints):
        return found
    done = 0
    for cue in _cue.finditer(text):
        if cue.start() < done:
            continue
        line = _spdx.match(text, cue.start())
        if line:
            found += spdx_line(text, line)
            done = line.end()
            continue
        ranked, blocks = [], []
        for begin, end in dict.fromkeys((max(b, done), e) for b, e in candidate_blocks(text, cue.start())):
            data = text[begin:end].lower().encode()
            size = len(alone().compress(data))
            for n, t in enumerate(templates()):
                reduced = size - len(t[3].compress(data))
                if reduced > 0:
                    # Of equal reductions the larger share comes first, then the shorter template.
                    ranked.append((reduced, reduced / size, -len(t[2]), -n, -len(blocks)))
            blocks.append(words_of(text, begin, end))
        for place, (_, share, _, n, b) in enumerate(sorted(ranked, reverse=True), 1):
            spans, words = blocks[-b]
            won = confirmed(words, spans, -n, cue.start())
            if won:
                found.append((templates()[-n][0], won[0], won[1], share, won[2], place))
                done = won[1]
                break
    return found


def scan_text(text: str) -> list[tuple[str, int, int, float | None, list[str]]]:
    """``walk_text`` without the places."""
    return [f[:5] for f in walk_text(text)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed license: doc_id, license, begin, end (code points), saved, n_different, differences, place.

    ``saved`` is the share that the winner takes off its block, ``place`` tells how many pairs were walked up to it; an SPDX line has null and 0.
    Null and empty texts and texts without license words give no row; a license that a text repeats gives a row each
    time; repeated rows give repeated results; a null id stays null. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                for spdx, begin, end, saved, diff, place in walk_text(text):
                    at.append(i)
                    rows.append((spdx, begin, end, None if saved is None else round(saved, 6), len(diff), " ".join(diff), place))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)]
            names = ["doc_id", "license", "begin", "end", "saved", "n_different", "differences", "place"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, license string, begin long, end long, saved double, n_different long, differences string, place long")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))
