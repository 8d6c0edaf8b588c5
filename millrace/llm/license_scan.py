"""License scans by template-markup matching.

A template is the wording of a license or notice with two kinds of markup:

    <<optional>> ... <</optional>>    wording that may be left out
    <<any:N>>                         up to N replaceable words (a name, a year, a title)

Each is compiled to a token automaton, whose states are the places between its words and are held as the
bits of a number. A text is accepted where a run of its words drives the automaton from its start to its
end, so mandatory wording must match word for word and optional or replaceable regions may vary. Regions
before the first mandatory word are not needed and not part of a run. The automaton runs only where the
template's first mandatory phrase stands, and goes on behind a run that it has accepted, so the work
is linear in the text.

Beside the templates, four base phrases are counted wherever their words stand consecutively, and SPDX tags are read
as what they are, expressions: identifiers joined by AND and OR, maybe in parentheses, each maybe WITH an exception, which
is no license. An identifier's label is itself in small letters, without -only, -or-later or +; its score is 0.8.

Words are runs of ASCII letters, digits and anything outside ASCII, with A-Z in lower case.
Defined results: null or empty text has no words, no places and score 0; rows are scanned one by
one, so repeated rows get the same result each. The score is the highest of the templates accepted (in those
given here 1 for the complete wording of a license, 0.8 for a notice that names one), or 0.5 for base
phrases alone. Runs of one template do not overlap; of those that begin at a place the shortest counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _kernel as K

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of well-known licenses and notices, as (label, score, template).
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE <<any:6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE <<any:6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<any:1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<any:1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. {}
    THIS SOFTWARE IS PROVIDED BY <<any:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
    ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ENDORSE = "<<any:1>> Neither the name of <<any:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = """is free software<<optional>>: <</optional>> you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software
    Foundation<<any:1>> either version {} of the License<<optional>>, or (at your option) any later version<</optional>>"""
TEMPLATES = [
    ("mit", 1.0, """Permission is hereby granted, free of charge, to any person obtaining a copy of <<any:12>> (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>>
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE <<any:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("isc", 1.0, """Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. """ + _AS_IS),
    ("0bsd", 1.0, "Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("bsd-2-clause", 1.0, _BSD.format("")),
    ("bsd-3-clause", 1.0, _BSD.format(_ENDORSE)),
    ("zlib", 1.0, """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: <<any:1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<any:1>> Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. <<any:1>> This notice may not be removed or altered from any
        source distribution"""),
    ("apache-2.0", 0.8, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any:8>> except in compliance with the License.
        You may obtain a copy of the License at <<any:12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License"""),
    ("gpl-2.0", 0.8, _GNU.format("", 2)), ("gpl-3.0", 0.8, _GNU.format("", 3)),
    ("lgpl-2.1", 0.8, _GNU.format("Lesser", 2.1)), ("lgpl-3.0", 0.8, _GNU.format("Lesser", 3)), ("agpl-3.0", 0.8, _GNU.format("Affero", 3)),
    ("mpl-2.0", 0.8, "is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with <<any:2>> file, You can obtain one at"),
    ("mit", 0.8, "under the <<optional>>terms of the<</optional>> MIT License"),
    ("apache-2.0", 0.8, "under the <<optional>>terms of the<</optional>> Apache License, Version 2.0"),
    ("gpl-2.0", 0.8, "under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>GPL<</optional>> <<optional>>v<</optional>> <<optional>>version<</optional>> 2"),
    ("gpl-3.0", 0.8, "under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>GPL<</optional>> <<optional>>v<</optional>> <<optional>>version<</optional>> 3"),
    ("cc-by-4.0", 0.8, "under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY 4.0"),
    ("cc-by-sa-4.0", 0.8, "under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", 0.8, "under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY-NC 4.0"),
]

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: An SPDX tag and its expression on one line; identifiers end with a letter, a digit or +.
_ID = r"[(]*[A-Za-z0-9.+-]*[A-Za-z0-9+][)]*"
TAG = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
_TAG, _WITH = re.compile(TAG.encode()), re.compile(rb"[ \t]WITH[ \t]+[^ \t]+")
SPDX_SCORE = 0.8
MARK = re.compile(r"<<(/?optional|any:\d+)>>")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


@dataclass
class Automaton:
    """From state s the word at place s of the template leads to s + 1; each (from, to) in `skips` leads on without a word."""

    label: str
    score: float
    after: dict[bytes, int] = field(default_factory=dict)  # word -> states that it leads on from
    any: int = 0  # states that every word leads on from
    skips: list[tuple[int, int]] = field(default_factory=list)  # by their first state
    skipping: int = 0
    end: int = 0
    head: bytes = b""  # the first mandatory phrase
    begin: int = 0  # the states behind it

    @classmethod
    def compile(cls, label: str, score: float, template: str) -> Automaton:
        out, words, opened, phrase, done = cls(label, score), [], [], [], False
        for i, part in enumerate(MARK.split(template)):
            if i % 2 == 0:
                tokens = normal_words(part.encode())
                if tokens and not opened and not done:
                    phrase, done, start = tokens, True, len(words) + len(tokens)
                words += tokens
            elif part == "optional":
                opened.append(len(words))
            elif part == "/optional":
                out.skips.append((opened.pop(), len(words)))
            else:
                n = int(part[4:])
                out.skips += [(len(words) + k, len(words) + n) for k in range(n)]
                words += [None] * n
        if opened or not done:
            raise ValueError(f"the template of {label} has no mandatory word, or an optional region is not closed")
        for s, word in enumerate(words):
            if word is None:
                out.any |= 1 << s
            else:
                out.after[word] = out.after.get(word, 0) | 1 << s
        out.skips.sort()
        out.skipping = sum({1 << s for s, _ in out.skips})
        out.end, out.head = 1 << len(words), b" ".join(phrase)
        out.begin = out.closed(1 << start)
        return out

    def closed(self, states: int) -> int:
        if states & self.skipping:
            for s, to in self.skips:
                if states >> s & 1:
                    states |= 1 << to
        return states

    def accepted(self, words: list[bytes], at: int) -> int | None:
        """The end of the shortest run that goes on at word `at`, behind the first mandatory phrase."""
        states, after, any_, end = self.begin, self.after, self.any, self.end
        while not states & end:
            if at == len(words):
                return None
            states = self.closed((states & (after.get(words[at], 0) | any_)) << 1)
            if not states:
                return None
            at += 1
        return at

    def runs(self, words: list[bytes], joined: bytes, starts: Sequence[int]) -> Iterator[tuple[int, int]]:
        """All accepted runs [start, end) of words that do not overlap. `starts` are the words' places in `joined`."""
        size, past = self.head.count(b" ") + 1, 0
        for place in places(joined, self.head):
            at = bisect_left(starts, place)
            if at >= past:
                end = self.accepted(words, at + size)
                if end is not None:
                    yield at, end
                    past = end


def spdx(text: bytes) -> set[str]:
    """Labels of the identifiers in the text's SPDX tags."""
    ids = {x.strip(b"()") for m in _TAG.finditer(text) for x in _WITH.sub(b" ", m[1]).split() if x not in (b"AND", b"OR")}
    return {re.sub(r"(-only|-or-later|\+)$", "", x.decode().lower()) for x in ids if x}


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Byte places where the phrase's words stand consecutively in words joined by one space."""
    at = joined.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or joined[at - 1] == 32) and (end == len(joined) or joined[end] == 32):
            yield at
        at = joined.find(phrase, at + 1)


def compiled(templates: Iterable[tuple[str, float, str]]) -> list[Automaton]:
    return [Automaton.compile(*t) for t in templates]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string())),
])


def scan(text: bytes, automata: list[Automaton]) -> tuple:
    words = normal_words(text)
    joined = b" ".join(words)
    starts = [0, *(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1).tolist()] if words else []
    found = [(bisect_left(starts, at), label) for phrase, label in BASE.items() for at in places(joined, phrase.encode())]
    base = {label for _, label in found}
    labels, score, spans = set(base), 0.5 if base else 0.0, []
    for a in automata:
        for start, end in a.runs(words, joined, starts):
            labels.add(a.label)
            score = max(score, a.score)
            spans.append(f"{a.label}:{start}-{end}")
    tagged = spdx(text)
    labels |= tagged
    score = max(score, SPDX_SCORE if tagged else 0.0)
    at = [x for x, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def _scan(templates: list[tuple[str, float, str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        for batch in K.sliced(batches, "text"):
            columns = zip(*(scan(t, automata) for t in K.texts_of(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return run


def licenses(docs: DataFrame, templates: Iterable[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, counts and places of base phrases, labels, score and all runs accepted, as label:start-end in words.

    `templates` are (label, score, text with markup), such as whole license texts of the caller's own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(list(templates)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")
