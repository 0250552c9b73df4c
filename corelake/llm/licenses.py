"""License scans: license templates with markup are compiled into token automata.

A template is text with the markup of published license lists: ``<<beginOptional>> ... <<endOptional>>`` may be left
out (and may be nested), ``<<var;name="copyright";original="...";match=".{0,5000}">>`` stands for text that the rule
matches. Rules are a stretch of any text (``.+``, ``.*``, ``.{a,b}``: b is in characters, a means a word at least unless it is 0) or words to choose from
(``(a|b c)``); others are refused. All other words are mandatory and must occur exactly, in order, whatever signs,
capitals and white space stand between them. Compiling gives, for each state, the mandatory words that lead on;
optional regions add a branch around themselves, replaceable regions a state that takes any word. What may be missing
before the first mandatory word, or after the last one, tells nothing.

A text is read once for each template, from all places that a match may start at together: a state holds the earliest
and the latest start that led to it, so the time follows the text's length whatever the text repeats.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, plain_words

# --- fixed values: phrases and labels of the base scan ---
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# --- fixed values: public license wordings with markup; whole licenses, and whole notices that declare one ---
_HOLDER = '<<var;name="copyright";original="Copyright (c) <year> <holder>";match=".{0,5000}">>'
_BULLET = '<<var;name="bullet";original="1.";match=".{0,20}">>'
_BSD = f"""{_HOLDER} Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met:
    {_BULLET} Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer.
    {_BULLET} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">>
    "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
    EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "MIT": f"""<<beginOptional>>The MIT License (MIT)<<endOptional>> {_HOLDER}
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="software";original="this software and associated documentation files";match="this software and associated documentation files|this source file">>
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL <<var;name="liable";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"""{_HOLDER} Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".+">>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"""{_BSD} {_BULLET} Neither the name of <<var;name="organization";original="the copyright holder";match=".+">>
        nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission. {_BSD_END}""",
    "Zlib": f"""{_HOLDER} This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: {_BULLET} The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. {_BULLET} Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. {_BULLET} This notice may not be removed or altered from any source
        distribution.""",
    "Apache-2.0-notice": f"""{_HOLDER} Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.html<<endOptional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-notice": """<<var;name="program";original="This program";match=".+">> is free software; you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software Foundation; either version
        <<var;name="version";original="2";match="2|3">> of the License, or (at your option) any later version.
        <<var;name="program";original="This program";match=".+">> is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/.""",
}
# --- fixed values: what declares a license by its name and version, and public license identifiers ---
_UNDER = '<<var;name="verb";match="licensed|released|distributed|published|available|provided|redistributed">> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>><<var;name="article";match="the|a|an">><<endOptional>>'


def _version(v: str) -> str:
    return f"""<<var;name="version";match="{'|'.join(x + v.replace('.', ' ') for x in ('version ', 'v ', 'v', ''))}">>"""


_GNU = {"GPL": "", "LGPL": '<<var;name="kind";match="lesser|library">>', "AGPL": "Affero"}
_CC = {"BY": "", "BY-SA": "ShareAlike", "BY-NC": "NonCommercial", "BY-ND": "NoDerivatives", "BY-NC-SA": "NonCommercial ShareAlike", "BY-NC-ND": "NonCommercial NoDerivatives"}
_NAMED = {
    "Apache-2.0": f"Apache <<beginOptional>>Software<<endOptional>> License {_version('2.0')}",
    "MIT": "MIT License",
    "ISC": "ISC License",
    "MPL-2.0": f"Mozilla Public License {_version('2.0')}",
    "EPL-2.0": f"Eclipse Public License {_version('2.0')}",
    "BSL-1.0": f"Boost Software License {_version('1.0')}",
    "BSD-2-Clause": 'BSD <<var;name="n";match="2|two">> Clause <<beginOptional>>License<<endOptional>>',
    "BSD-3-Clause": 'BSD <<var;name="n";match="3|three">> Clause <<beginOptional>>License<<endOptional>>',
    **{f"{kind}-{v}": f"GNU {name} General Public License <<beginOptional>>{kind}<<endOptional>> <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> {_version(v.removesuffix('.0'))}"
       for kind, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",))) for v in versions for name in [_GNU[kind]]},
    **{f"CC-{kind}-{v}": f'<<var;name="cc";match="CC {kind}|Creative Commons Attribution {name}">> <<beginOptional>>License<<endOptional>> {_version(v)}' for kind, name in _CC.items() for v in ("2.0", "3.0", "4.0")},
}
_IDENTIFIERS = ("MIT", "ISC", "Zlib", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_ONLY = '<<beginOptional>><<var;name="later";match="only|or later">><<endOptional>>'
_BEFORE = f"""<<beginOptional>><<var;name="other";match="{'|'.join(x.replace('.', ' ') for x in _IDENTIFIERS)}">> {_ONLY} <<var;name="and";match="or|and">><<endOptional>>"""
DECLARATIONS = {f"{label} declared": f"{_UNDER} {name}" for label, name in _NAMED.items()} | {f"{label} tagged": f"SPDX-License-Identifier: {_BEFORE} {label}" for label in _IDENTIFIERS}
#: Among the three words before a declaration these deny it.
_DENIALS = {b"not", b"never", b"nor", b"no", b"longer", b"t", b"cannot"}

_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[a-zA-Z]+=(?:\"[^\"]*\"|[^\">;]*))*)>>")
_RULE = re.compile(r";match=(?:\"([^\"]*)\"|([^\">;]*))")
_STRETCH = re.compile(r"\.(?:([*+])|\{(\d+),(\d*)\})\Z")
_WORDS = re.compile(r"[\w\s|(),.:;'/-]*\Z")


def parsed(template: str) -> list:
    """Items in turn: a word (bytes), ("optional", items), ("any", least, most characters or None), ("choice", phrases)."""
    levels, last = [[]], 0
    for mark in _MARK.finditer(template):
        levels[-1] += plain_words(template[last : mark.start()])
        last = mark.end()
        if mark[1] == "beginOptional":
            levels.append([])
        elif mark[1] == "endOptional":
            if len(levels) < 2:
                raise ValueError("an optional region ends that did not begin")
            done = levels.pop()
            levels[-1].append(("optional", done))
        else:
            rule = _RULE.search(mark[2])
            rule = (rule[1] if rule[1] is not None else rule[2]) if rule else ".+"
            if found := _STRETCH.match(rule):
                least, most = (int(found[1] == "+"), None) if found[1] else (int(found[2] or 0), int(found[3]) if found[3] else None)
                levels[-1].append(("any", least, most))
            elif _WORDS.match(rule):
                levels[-1].append(("choice", [plain_words(x) for x in rule.strip("()").split("|")]))
            else:
                raise ValueError(f"no automaton for the rule {rule!r}")
    levels[-1] += plain_words(template[last:])
    if len(levels) > 1 or "<<" in re.sub(_MARK, "", template):
        raise ValueError("a template needs closed regions and known marks")
    return levels[0]


def _skippable(item) -> bool:
    return isinstance(item, tuple) and (item[0] == "optional" or item[0] == "any" and item[1] == 0)


class Automaton:
    """States are numbers; ``step[s][word]`` are the next states, ``free[s]`` those without a word, ``loop[s]`` the most
    characters that a state takes of any words (None: no bound; states that take none are left out)."""

    def __init__(self, template: str):
        items = parsed(template)
        while items and (_skippable(items[0]) or isinstance(items[0], tuple) and items[0][0] == "any"):
            items.pop(0)
        while items and isinstance(items[-1], tuple) and items[-1][0] == "any" and items[-1][1] == 0:
            items.pop()
        self.step: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.loop: dict[int, int | None] = {}
        self.one: dict[int, int] = {}  # states that take exactly one word of any kind
        self.needs = {x for x in items if isinstance(x, bytes)}
        self.mandatory = sum(isinstance(x, bytes) for x in items)
        if not self.mandatory or isinstance(items[0], tuple) and (items[0][0] != "choice" or not all(items[0][1])):
            raise ValueError("a template needs mandatory words, and begins with some but for regions that may be missing")
        if isinstance(items[-1], tuple) and items[-1][0] == "any":
            items[-1] = ("one",)  # what stands at the end has no end of its own: one word is enough
        self.final = self._chain(0, items)
        self.first = {items[0]} if isinstance(items[0], bytes) else {phrase[0] for phrase in items[0][1]}

    def _new(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def _chain(self, at: int, items: list) -> int:
        for item in items:
            end = self._new()
            if isinstance(item, bytes):
                self.step[at].setdefault(item, []).append(end)
            elif item[0] == "optional":
                inner = self._new()
                self.free[at] += [inner, end]
                self.free[self._chain(inner, item[1])].append(end)
            elif item[0] == "choice":
                for phrase in item[1]:
                    inner = self._new()
                    self.free[at].append(inner)
                    self.free[self._chain(inner, phrase)].append(end)
            elif item[0] == "one":
                self.one[at] = end
            else:
                loop = self._new()
                self.loop[loop] = item[2]
                if item[1]:
                    self.one[at] = loop  # a word at least
                else:
                    self.free[at].append(loop)
                self.free[loop].append(end)
            at = end
        return at

    def ends(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(end, earliest start, latest start) for each place at which texts that the template accepts end."""
        out: list[tuple[int, int, int]] = []
        states: dict[int, tuple[int, int]] = {}  # the earliest and the latest start that led to each
        stretches = {s: Stretch(most) for s, most in self.loop.items()}
        used = [0]  # characters up to each place, with a space after each word

        def enter(states: dict, s: int, low: int, high: int, since: int) -> None:
            todo = [s]
            while todo:
                s = todo.pop()
                if s in stretches:
                    stretches[s].add(used[since], low, high)
                old = states.get(s)
                if old is None or low < old[0] or high > old[1]:
                    states[s] = (low, high) if old is None else (min(low, old[0]), max(high, old[1]))
                    todo += self.free[s]

        for at, word in enumerate(words):
            used.append(used[-1] + len(word) + 1)
            if word in self.first:
                enter(states, 0, at, at, at)
            if not states:
                continue
            new: dict[int, tuple[int, int]] = {}
            for s, (low, high) in states.items():
                for t in self.step[s].get(word, ()):
                    enter(new, t, low, high, at + 1)
                if s in self.one and len(word) <= (self.loop.get(self.one[s]) or len(word)):
                    enter(new, self.one[s], low, high, at)
                if s in stretches and (still := stretches[s].live(used[-1] - 1)):
                    for t in (s, *self.free[s]):
                        if t == s:
                            old = new.get(s, still)
                            new[s] = min(old[0], still[0]), max(old[1], still[1])
                        else:
                            enter(new, t, *still, at + 1)
            states = new
            if self.final in states:
                out.append((at + 1, *states[self.final]))
        return out


class Stretch:
    """Starts that led to a stretch of any words, of so many characters at most, from where each entered it.

    An entry counts no more once another one entered later from an earlier start (for the earliest) or from a later
    one (for the latest): what is left is in order, so each entry comes and goes once.
    """

    def __init__(self, most: int | None):
        self.most = most
        self.low: deque[tuple[int, int]] = deque()
        self.high: deque[tuple[int, int]] = deque()

    def add(self, since: int, low: int, high: int) -> None:
        if self.most is None:  # nothing ever ends here
            if self.low:
                low, high = min(low, self.low[0][1]), max(high, self.high[0][1])
            self.low, self.high = deque([(since, low)]), deque([(since, high)])
            return
        while self.low and self.low[-1][1] >= low and self.low[-1][0] <= since:
            self.low.pop()
        while self.high and self.high[-1][1] <= high and self.high[-1][0] <= since:
            self.high.pop()
        if not self.low or self.low[-1][0] <= since:
            self.low.append((since, low))
        if not self.high or self.high[-1][0] <= since:
            self.high.append((since, high))

    def live(self, used: int) -> tuple[int, int] | None:
        """The earliest and the latest start of the entries that may take what has been used up to here."""
        if self.most is not None:
            for entries in (self.low, self.high):
                while entries and used - entries[0][0] > self.most:
                    entries.popleft()
        return (self.low[0][1], self.high[0][1]) if self.low else None


@cache
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(template)) for label, template in templates]


def found_by(one: Automaton, words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of accepted texts: for each end the earliest and the latest start, for each start its last end."""
    last: dict[int, int] = {}
    for end, *starts in one.ends(words):
        last.update(dict.fromkeys(starts, end))
    return sorted(last.items())


def scan_words(words: list[bytes], automata: list[tuple[str, Automaton]], phrases: dict[bytes, tuple[list[bytes], str]]) -> tuple:
    """(base places, first, last, base labels, [(label, start, end)]) of a text's words."""
    there = set(words)
    places, labels, matches = [], set(), []
    if seen := phrases.keys() & there:
        for at, word in enumerate(words):
            if word in seen:
                for phrase, label in phrases[word]:
                    if words[at : at + len(phrase)] == phrase:
                        places.append(at)
                        labels.add(label)
    for label, one in automata:
        if one.needs <= there and not one.first.isdisjoint(there):
            matches += [(label, at, end) for at, end in found_by(one, words)]
    return len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(matches)


def scan_licenses(
    docs: DataFrame, *, text: str = "text", templates: dict[str, str] = TEMPLATES, declarations: dict[str, str] = DECLARATIONS, keep: list[str] | None = None
) -> DataFrame:
    """One row for each row of docs: doc, n_words, n_base, first_word, last_word, base_labels, labels, matches, score.

    ``templates`` gives markup of whole licenses and notices by label, ``declarations`` that of sentences and tags which
    name a license; one that is denied ("not licensed under ...") doesn't count. ``matches`` holds the matches (label,
    start, end in words): where several end together, those of the earliest and the latest start. ``score`` is 1 if a
    whole mandatory wording stands in the text, 0.75 if a declaration does, 0.5 if only a phrase does, else 0. A null or
    empty text has no words, no labels and score 0. A place of a phrase is counted each time it occurs.
    """
    held = tuple(templates.items()), tuple(declarations.items())
    for marked in held:
        compiled(marked)  # a template that can't be compiled raises here
    results = T.StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, matches array<struct<label: string, start: long, end: long>>, score double")

    def make():
        whole, named = compiled(held[0]), compiled(held[1])
        phrases: dict[bytes, list] = defaultdict(list)
        for phrase, label in PHRASES.items():
            phrases[plain_words(phrase)[0]].append((plain_words(phrase), label))

        def scan(texts):
            out = {f.name: [] for f in results}
            for one in texts:
                words = plain_words(one)
                n, first, last, base, matches = scan_words(words, whole, phrases)
                declared = [m for m in scan_words(words, named, {})[4] if _DENIALS.isdisjoint(words[max(0, m[1] - 3) : m[1]])]
                score = 1.0 if matches else 0.75 if declared else 0.5 if base else 0.0
                matches = sorted(matches + declared)
                labels = sorted({*base, *(m[0] for m in matches)})
                row = (len(words), n, first, last, base, labels, [dict(zip(("label", "start", "end"), m, strict=True)) for m in matches], score)
                for name, value in zip(out, row):
                    out[name].append(value)
            return out

        return scan

    return map_text(docs, make, results, text, keep)
