"""License scans: templates with optional and replaceable regions, compiled to token automata that accept exact wording.

A template is words with markup: `[a b]` may stand or be missing (nested too), `{2-8}` stands for any 2 to 8 words; all
other words are mandatory. Its clauses are the mandatory words between regions. An automaton starts wherever its first
clause stands and accepts where all mandatory words follow exactly, with nothing between them but what regions allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Phrases whose mere presence is told, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY_MIT = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {1-12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_TAIL = "this software is provided by {1-12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-12} be liable for any direct indirect incidental special exemplary or consequential damages"
#: Fixed values: (label, template). The wording is that of the licenses and of the notices that name them.
TEMPLATES = [
    ("mit-text", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software {_WARRANTY_MIT}"),
    ("isc-text", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-2-clause-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause-text", f"{_BSD_HEAD} [3] neither the name of {{1-12}} nor the names of [its] contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_TAIL}"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
    ("mit", "released under the [terms of the] mit license"),
    ("mit", "licensed under the [terms of the] mit license"),
    ("mit", "distributed under the [terms of the] mit license"),
    ("apache-2.0", "licensed under the [terms of the] apache license version 2 0"),
    ("apache-2.0", "released under the [terms of the] apache license version 2 0"),
    ("gpl-2.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation [either]] version 2"),
    ("gpl-3.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation [either]] version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation [either] version 2"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation [either] version 3"),
    ("gpl-or-later", "general public license [as published by the free software foundation [either]] version {1-1} [of the license] or [at your option] any later version"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under [a] [the] [creative commons] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [a] [the] [creative commons] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [a] [the] [creative commons] cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [a] [the] [creative commons] cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "licensed under [a] [the] [creative commons] cc by nd 4 0"),
    ("cc-by-4.0", "licensed under [a] [the] creative commons attribution 4 0 [international] [public] license"),
    ("cc-by-sa-4.0", "licensed under [a] [the] creative commons attribution sharealike 4 0 [international] [public] license"),
    ("cc-by-nc-4.0", "licensed under [a] [the] creative commons attribution noncommercial 4 0 [international] [public] license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0 [only] [or later]"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 [only] [or later]"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
]

#: Words are what these bytes leave: A-Z as a-z, and all ASCII but letters and digits as separators.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_MARK = re.compile(r"\[|\]|\{(\d+)-(\d+)\}|[^\s\[\]{}]+")
#: Score of a document that has a phrase but no template.
PHRASE_SCORE = 0.5


def license_words(text: str | None) -> list[bytes]:
    r"""The words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Automaton:
    """States are numbered; step[s] has (word or None for any, next state), skip[s] next states without a word."""

    label: str
    opening: bytes  # the words of the first clause, with a space around each
    first: int  # state after the first clause
    n_first: int
    step: list[list[tuple[bytes | None, int]]]
    skip: list[list[int]]
    clause_ends: dict[int, float]  # state -> share of the mandatory words that stand up to it
    accept: int

    def closed(self, states: set[int]) -> set[int]:
        ahead = list(states)
        while ahead:
            for s in self.skip[ahead.pop()]:
                if s not in states:
                    states.add(s)
                    ahead.append(s)
        return states

    def run(self, words: list[bytes], at: int) -> tuple[int | None, float]:
        """Where the longest accepted text that starts with the first clause at word `at` ends (None: none), and the share of mandatory words that stand."""
        states, at, end, share = self.closed({self.first}), at + self.n_first, None, 0.0
        while True:
            share = max([share, *(self.clause_ends[s] for s in states if s in self.clause_ends)])
            if self.accept in states:
                end = at
            if at == len(words):
                return end, share
            word = words[at]
            states = self.closed({to for s in states for want, to in self.step[s] if want is None or want == word})
            if not states:
                return end, share
            at += 1


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template, which starts with a mandatory word."""
    step: list[list] = [[]]
    skip: list[list] = [[]]
    opened: list[int] = []  # states before the optional regions that are open
    counts: dict[int, int] = {}  # mandatory words up to a state that a clause may end at
    total, opening, first = 0, [], None

    def new(before: int, word: bytes | None) -> int:
        step.append([])
        skip.append([])
        step[before].append((word, len(step) - 1))
        return len(step) - 1

    now = 0
    for m in _MARK.finditer(template):
        if m[0] in "[]" or m[1]:
            if first is None:
                first = now
            if not opened:
                counts[now] = total
        if m[0] == "[":
            opened.append(now)
        elif m[0] == "]":
            skip[opened.pop()].append(now)
        elif m[1]:
            early = []
            for i in range(int(m[2])):
                if i >= int(m[1]):
                    early.append(now)
                now = new(now, None)
            for s in early:
                skip[s].append(now)
        else:
            now = new(now, m[0].encode())
            if first is None:
                opening.append(m[0].encode())
            total += not opened
    if opened or not opening:
        raise ValueError(f"a template starts with a word and closes its regions: {template[:60]}")
    counts[now] = total
    return Automaton(label, b" " + b" ".join(opening) + b" ", now if first is None else first, len(opening), step, skip, {s: n / total for s, n in counts.items()}, now)


def places(text: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which a phrase (a space around each word) stands in words joined likewise."""
    at, seen, n = text.find(phrase), 0, 0
    while at >= 0:
        n += text.count(b" ", seen, at)
        yield n
        seen, at = at, text.find(phrase, at + 1)


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
_FOUND = pa.schema([("n_words", pa.int32()), ("phrases", _PLACES), ("licenses", _PLACES), ("mandatory", pa.float64())])
FOUND = "n_words int, phrases array<struct<label: string, start: int, length: int>>, licenses array<struct<label: string, start: int, length: int>>, mandatory double"


def scan_text(text: str | None, automata: list[Automaton]) -> dict:
    words = license_words(text)
    line = b" " + b" ".join(words) + b" "
    phrases = [(label, at, phrase.count(" ") + 1) for phrase, label in PHRASES.items() for at in places(line, f" {phrase} ".encode())]
    found, best = set(), 0.0
    for a in automata:
        if a.opening in line:
            for at in places(line, a.opening):
                end, share = a.run(words, at)
                best = max(best, share)
                if end is not None:
                    found.add((a.label, at, end - at))
    as_rows = lambda rows: [{"label": k, "start": s, "length": n} for k, s, n in sorted(rows, key=lambda r: (r[1], r[0], r[2]))]
    return {"n_words": len(words), "phrases": as_rows(phrases), "licenses": as_rows(found), "mandatory": best}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, phrases and licenses (label, first word and number of words of each place, in order) and mandatory (the greatest share of a template's mandatory words that stand, clause by clause) for each row of docs (doc_id, text).

    A license is a text that the automaton of a template accepts, the longest from each start; two templates of one
    label that accept the same words give one place. Null texts and texts without words have no places and a
    share of 0. Texts of any length are scanned whole. Repeated rows and rows without doc_id come back as often as
    given; other columns are left aside; an empty table gives an empty result.
    """
    automata = [compile_template(*t) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([scan_text(text.as_py(), automata) for text in batch.column(1)], _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.columns], ["doc_id", *_FOUND.names])

    of_id = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {of_id}, {FOUND}")


def license_digest(found: DataFrame) -> DataFrame:
    """scan_licenses in one row of counts and labels for each document. score is the share of mandatory words, and PHRASE_SCORE at least where a phrase stands."""
    starts = F.transform("phrases", lambda p: p["start"].cast("long"))
    base, own = (F.transform(c, lambda p: p["label"]) for c in ("phrases", "licenses"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    n_base = F.size("phrases").cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, own)).alias("labels"),
        F.greatest("mandatory", F.when(n_base > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
    )
