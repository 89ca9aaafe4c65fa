"""Operator 6: license scans by template-markup matching.

A template is a license's wording with marked regions: [[words]] may be missing, {{name:lo-hi}} stands for lo to hi
words of any kind, and (a|b) for one of several words. It is compiled into an automaton over word hashes. The
automaton starts at every place where a word can begin a template and accepts if all mandatory wording follows
exactly, so a text that opens like a license and then changes a condition is not accepted. LICENSES are whole license texts (of one
license that is too long for that, the notice that it prescribes), NOTICES are lines that name a license. Beside
them, plain phrases are counted at every place where their words stand in a row.

Defined results: a null text is empty; without any place, first_word and last_word are null, both label columns
are empty strings and the score is 0. The score is 1 if a license's text was accepted, 0.75 if a notice was and 0.5 if only plain phrases
were found. Repeated rows each give a row, a null doc_id stays null, an empty table gives an empty result, and other columns are ignored,
whatever their names. A very long text is read by one task, in memory in proportion to its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _text

#: Plain phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wording of public licenses, in lower case and without punctuation, with the regions that may differ marked.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the {{holders:1-6}} be liable for any claim damages or other liability whether in an action of "
    "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_NO_DAMAGES = (
    "the software is provided as is and {{author:1-4}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{author:1-4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by {{owner:1-8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall {{owner:1-8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
    "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
LICENSES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _AS_IS,
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _NO_DAMAGES),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted " + _NO_DAMAGES),
    ("bsd-2", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    (
        "bsd-3",
        f"{_BSD_CONDITIONS} [[3]] neither the name of {{{{owner:1-8}}}} nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission {_BSD_DISCLAIMER}",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law " + _AS_IS,
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{place:1-10}} "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
)
NOTICES = (
    ("mit", "[[this {{what:1-3}} is]] (licensed|released|distributed|available) under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("bsd", "(licensed|released|distributed) under the [[{{clauses:1-2}} clause]] bsd license"),
    ("gpl-2", "(licensed|distributed|released) under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("gpl-3", "(licensed|distributed|released) under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license"),
    ("agpl", "under the [[terms of the]] gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license [[v {{v:0-1}}]] [[version]] 2 [[0]]"),
    ("cc0", "has waived all copyright [[and related or neighboring rights]] to {{work:1-6}} under cc0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] (cc|creative) [[commons]] (by|attribution) (nc|noncommercial)"),
    ("cc-by-sa", "licensed under [[a]] [[the]] (cc|creative) [[commons]] (by|attribution) (sa|sharealike)"),
    ("cc-by", "licensed under [[a]] [[the]] (cc|creative) [[commons]] (by|attribution) [[international]] 4 0"),
    ("all-rights-reserved", "copyright [[c]] {{holder:0-6}} all rights reserved"),
)
_PART = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)-(\d+)\}\}|\(([^)]*)\)|[^\s\[\]{}()]+")
ANY = "*"

Tree = list  # of words (tuples of alternatives), ("any", lo, hi) and ("maybe", Tree)


def parse(template: str) -> Tree:
    stack: list[Tree] = [[]]
    for m in _PART.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif m[1] is not None:
            stack[-1].append(("any", int(m[1]), int(m[2])))
        else:
            stack[-1].append(("words", tuple((m[3] if m[3] is not None else m[0]).split("|"))))
    if len(stack) != 1:
        raise ValueError(f"unbalanced region in {template!r}")
    return stack[0]


class Automaton:
    """States are numbers; `step` maps a state to words and the state that follows, `skip` to states reached without a word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[str, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.end = self._add(parse(template), 0)

    def _state(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _add(self, tree: Tree, at: int) -> int:
        for kind, *rest in tree:
            if kind == "words":
                to = self._state()
                self.step[at] += [(word, to) for word in rest[0]]
                at = to
            elif kind == "any":
                places = [at]
                for _ in range(rest[1]):
                    to = self._state()
                    self.step[places[-1]].append((ANY, to))
                    places.append(to)
                at = self._state()
                for p in places[rest[0] :]:
                    self.skip[p].append(at)
            else:
                inner = self._add(rest[0], at)
                to = self._state()
                self.skip[at].append(to)
                self.skip[inner].append(to)
                at = to
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skip[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def hashed(self, word_hash) -> Scanner:
        """With hashes for words; every set of states is computed once, when it is first reached."""
        return Scanner(self, [[(w if w == ANY else word_hash[w], to) for w, to in s] for s in self.step])


class Scanner:
    def __init__(self, machine: Automaton, step: list[list[tuple[object, int]]]):
        self.machine, self.step = machine, step
        self.known: dict[frozenset[int], dict[object, frozenset[int]]] = {}
        self.start = frozenset(machine.closure({0}))
        self.first = {w for s in self.start for w, _ in step[s]}
        if ANY in self.first:
            raise ValueError("a template can't begin with a replaceable region")
        self.second = {w for word in self.first for t in self._follow(self.start, word) for w, _ in step[t]}

    def _follow(self, states: frozenset[int], word: int) -> frozenset[int]:
        moves = self.known.get(states)
        if moves is None:
            words = {w for s in states for w, _ in self.step[s]}
            moves = self.known[states] = {w: frozenset(self.machine.closure({to for s in states for x, to in self.step[s] if x == w or x == ANY})) for w in words | {ANY}}
        return moves.get(word) or moves[ANY]

    def starts(self, h: np.ndarray) -> np.ndarray:
        """Places of the first word of a template whose next word may be its second."""
        at = np.flatnonzero(np.isin(h, np.array(sorted(self.first), np.uint64)))
        if ANY in self.second or not len(at):
            return at
        return at[np.isin(np.append(h, np.uint64(0))[at + 1], np.array(sorted(self.second), np.uint64))]

    def accepts(self, h: np.ndarray, at: int, end: int) -> bool:
        """Whether some words from `at` on, before `end`, are in the template's language."""
        states = self.start
        while at < end and states and self.machine.end not in states:
            states = self._follow(states, int(h[at]))
            at += 1
        return self.machine.end in states


def _hash_words(words: list[str]) -> dict[str, int]:
    w = _text.words(pa.array([" ".join(words)]), _text.NOT_ALNUM)
    if len(w.hash) != len(words):
        raise ValueError("a template's words must each be one word of a text")
    return dict(zip(words, w.hash.tolist(), strict=True))


def _compile():
    machines = [(label, Automaton(t), score) for score, templates in ((1.0, LICENSES), (0.75, NOTICES)) for label, t in templates]
    named = sorted({w for _, m, _ in machines for s in m.step for w, _ in s if w != ANY})
    hashes = _hash_words(named)
    scanners = [(label, m.hashed(hashes), score) for label, m, score in machines]
    phrases = [(label, np.array([_hash_words([w])[w] for w in phrase.split()], np.uint64)) for phrase, label in PHRASES.items()]
    return scanners, phrases


_compiled: list = []


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    if not _compiled:
        _compiled.append(_compile())
    scanners, phrases = _compiled[0]
    w = _text.words(batch.column("text"), _text.NOT_ALNUM)
    n, row, h = batch.num_rows, w.row, w.hash
    count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    for label, words in phrases:
        k = len(words)
        if len(h) < k:
            continue
        hit = row[: len(h) - k + 1] == row[k - 1 :]
        for j, x in enumerate(words):
            hit &= h[j : len(h) - k + 1 + j] == x
        at = np.flatnonzero(hit)
        r = row[at]
        np.add.at(count, r, 1)
        np.minimum.at(low, r, at - w.first[r])
        np.maximum.at(high, r, at - w.first[r])
        for x in np.unique(r).tolist():
            base[x].add(label)
    found: list[set[str]] = [set() for _ in range(n)]
    best = np.where(count > 0, 0.5, 0.0)
    for label, s, score in scanners:
        for at in s.starts(h).tolist():
            r = int(row[at])
            if (label not in found[r] or best[r] < score) and s.accepts(h, at, int(w.first[r + 1])):
                found[r].add(label)
                best[r] = max(best[r], score)
    none = count == 0
    join = lambda x: ",".join(sorted(x))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(w.counts.astype(np.int64)),
            pa.array(count),
            pa.array(low, mask=none),
            pa.array(high, mask=none),
            pa.array([join(x) for x in base]),
            pa.array([join(x | y) for x, y in zip(base, found, strict=True)]),
            pa.array(best),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _text.map_text(texts, _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
