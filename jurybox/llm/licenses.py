"""License scans: notices and license texts by templates with optional and replaceable regions.

A template is a line of words. `[[...]]` may be absent, `{{a-b}}` stands for a to b words of any
kind; all other words are mandatory and must stand there exactly, in order. All templates are
compiled into one automaton over words: a position per word, the positions that may follow it, and
the words that enter it. A text is read once; a thread starts at each word some template begins
with, and is followed for as long as any template still fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jurybox.llm.common import give_back


@dataclass(frozen=True)
class Template:
    """`label` of the texts that hold the wording of `markup`; base templates are plain phrases."""

    label: str
    markup: str
    base: bool = False


# The phrases of the base scan and their labels.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Wording of common license notices and texts, lower case, without punctuation.
_CC = "[[the]] [[a]] [[creative commons]]"
_AS_IS = ("{{1-12}} provided {{0-12}} as is and any express or implied warranties including but not limited to the implied "
          "warranties of merchantability and fitness for a particular purpose are disclaimed")
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
        "with the distribution")
TEMPLATES = (
    Template("MIT", "released under [[the terms of]] the mit license"),
    Template("MIT", "licensed under [[the terms of]] the mit license"),
    Template("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files [[the software]] to deal in the software without restriction including without limitation the "
             "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
             "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
             "and this permission notice [[including the next paragraph]] shall be included in all copies or substantial "
             "portions of the software the software is provided as is without warranty of any kind"),
    Template("ISC", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    Template("BSD-3-Clause", f"{_BSD} [[3]] neither the name of {{{{1-12}}}} nor the names of its contributors may be used to "
             "endorse or promote products derived from this software without specific prior written permission"),
    Template("Apache-2.0", "licensed under [[the terms of]] the apache license version 2 0"),
    Template("Apache-2.0", "released under [[the terms of]] the apache license version 2 0"),
    Template("Apache-2.0", "you may not use {{1-4}} except in compliance with the license [[you may obtain a copy of the license "
             "at {{1-8}}]] unless required by applicable law or agreed to in writing software distributed under the license is "
             "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    *[Template(f"{name}-{v}.0", f"{verb} under [[the terms of]] the gnu {kind}general public license [[as published by the free "
               f"software foundation]] [[either]] version {v}")
      for name, kind in (("GPL", ""), ("LGPL", "lesser "), ("AGPL", "affero ")) for v in (2, 3) if (name, v) not in (("LGPL", 2), ("AGPL", 2))
      for verb in ("licensed", "released", "distributed")],
    *[Template(f"GPL-{v}.0", "you can redistribute it and or modify it under the terms of the gnu general public license as "
               f"published by the free software foundation either version {v} of the license or at your option any later version")
      for v in (2, 3)],
    Template("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
             "was not distributed with this file you can obtain one at {{1-8}}"),
    *[Template(f"CC-{name}-4.0", f"{verb} under {_CC} cc {words} 4 0") for name, words in
      (("BY", "by"), ("BY-SA", "by sa"), ("BY-NC", "by nc"), ("BY-ND", "by nd"), ("BY-NC-SA", "by nc sa"), ("BY-NC-ND", "by nc nd"))
      for verb in ("licensed", "released")],
    *[Template(f"CC-{name}-4.0", f"creative commons {words} 4 0 [[international]] [[public]] license") for name, words in
      (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"),
       ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"),
       ("BY-NC-ND", "attribution noncommercial noderivatives"))],
    Template("CC0-1.0", "released under [[the]] [[creative commons]] cc0 1 0"),
    Template("Unlicense", "this is free and unencumbered software released into the public domain"),
    Template("Proprietary", "copyright [[c]] {{1-12}} all rights reserved [[worldwide]]"),
)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKS = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
PIECE = 1 << 20  # bytes of a text split into words at once
SURE = 4  # a template of m mandatory words gives the score m / (m + SURE)

PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("score", T.DoubleType())])


def parse(markup: str) -> Iterator[tuple[str, int, int]]:
    """The marks of a template: ("word", ...) as (word, 1, 1), any words as ("", a, b), and [[ and ]] as they are."""
    depth = 0
    for found in _MARKS.finditer(markup):
        mark = found.group()
        depth += (mark == "[[") - (mark == "]]")
        if depth not in (0, 1):
            raise ValueError(f"optional regions must be closed and not nested: {markup!r}")
        if found.group(2):
            low, high = int(found.group(1)), int(found.group(2))
            if not 0 <= low <= high or high == 0:
                raise ValueError(f"a replaceable region takes a to b words, 0 <= a <= b: {mark}")
            yield "", low, high
        else:
            yield mark, 1, 1
    if depth:
        raise ValueError(f"an optional region is not closed: {markup!r}")


def mandatory_words(markup: str) -> int:
    """How many words of the template must stand there exactly."""
    count, inside = 0, False
    for mark, _, _ in parse(markup):
        if mark in ("[[", "]]"):
            inside = mark == "[["
        elif mark and not inside:
            count += 1
    return count


@dataclass
class Automaton:
    """All templates as one automaton; a set of positions is a whole number's bits."""

    templates: Sequence[Template]
    enters: dict[bytes, int] = field(default_factory=dict)  # positions a word may take
    any_word: int = 0  # positions every word may take
    first: int = 0  # positions a template may begin with
    follow: list[int] = field(default_factory=list)  # positions that may come after one
    ends: dict[int, list[int]] = field(default_factory=dict)  # position -> templates complete with it

    def __post_init__(self) -> None:
        for number, template in enumerate(self.templates):
            self._add(number, template.markup)
        if self.first & self.any_word:
            raise ValueError("a template begins with a word of its own")
        self.begins = {word for word, bits in self.enters.items() if bits & self.first}
        self.last = sum(1 << p for p in self.ends)

    def _add(self, number: int, markup: str) -> None:
        words: list[str] = []
        skips: dict[int, set[int]] = {}
        opened = 0
        for mark, low, high in parse(markup):
            if mark == "[[":
                opened = len(words)
            elif mark == "]]":
                skips.setdefault(opened, set()).add(len(words))
            elif mark:
                words.append(mark)
            else:
                for k in range(high):
                    if k >= low:
                        skips.setdefault(len(words), set()).add(len(words) + 1)
                    words.append("")
        size, base = len(words), len(self.follow)
        reach: list[set[int]] = [set() for _ in range(size + 1)]
        for at in range(size, -1, -1):
            reach[at] = {at}.union(*[reach[t] for t in skips.get(at, ())])
        if size in reach[0]:
            raise ValueError(f"a template needs a mandatory word: {markup!r}")

        def bits(places: set[int]) -> int:
            return sum(1 << base + p for p in places if p < size)

        self.first |= bits(reach[0])
        for at, word in enumerate(words):
            self.follow.append(bits(reach[at + 1]))
            if size in reach[at + 1]:
                self.ends.setdefault(base + at, []).append(number)
            if word:
                key = word.encode()
                self.enters[key] = self.enters.get(key, 0) | 1 << base + at
            else:
                self.any_word |= 1 << base + at

    def after(self, positions: int) -> int:
        out = 0
        while positions:
            low = positions & -positions
            out |= self.follow[low.bit_length() - 1]
            positions ^= low
        return out

    def scan(self, pieces: Iterator[list[bytes]]) -> tuple[int, list[tuple[int, int, int]]]:
        """(words, places) of a text given as lists of words; a place is (template, first word, word after).

        Of the places of a template that begin at the same word the shortest counts.
        """
        places: list[tuple[int, int, int]] = []
        threads: list[tuple[int, int, set[int]]] = []  # first word, positions, templates already complete
        offset = 0
        begins, enters, any_word, last = self.begins, self.enters, self.any_word, self.last
        for words in pieces:
            candidates = [i for i, w in enumerate(words) if w in begins]
            at, k = 0, 0
            while at < len(words):
                if not threads:
                    while k < len(candidates) and candidates[k] < at:
                        k += 1
                    if k == len(candidates):
                        break
                    at = candidates[k]
                fits = enters.get(words[at], 0)
                moved = [(begin, self.after(on) & (fits | any_word), done) for begin, on, done in threads]
                if fits & self.first:
                    moved.append((offset + at, fits & self.first, set()))
                threads = [m for m in moved if m[1]]
                for begin, on, done in threads:
                    complete = on & last
                    while complete:
                        low = complete & -complete
                        for number in self.ends[low.bit_length() - 1]:
                            if number not in done:
                                done.add(number)
                                places.append((number, begin, offset + at + 1))
                        complete ^= low
                at += 1
            offset += len(words)
        return offset, places


def words_in_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of bounded size; no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, end)
            end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def scan_licenses(df: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Rows of `df` as struct `row`, with `n_words` and `places`, all accepted places of base phrases and templates.

    A place is (label, base, start, end, score), in words, end exclusive, ordered by start and end. Null
    and empty texts have no words and no places. Rows are judged by themselves: repeated rows, ties and
    columns of any name stay as they are inside `row`; an empty table gives an empty table. Long texts
    are split a mebibyte at a time; nothing is shuffled.
    """
    known = (*BASE, *templates)
    Automaton(known)  # a faulty template fails here, not in a task
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(PLACE))])
    column = df.columns.index(text)
    types = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                       ("score", pa.float64())])
    scores = [score_of(t) for t in known]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(known)
        for batch in batches:
            counts, found = [], []
            for value in batch.column(column):
                body = value.as_buffer().to_pybytes() if value.is_valid else b""
                n, places = automaton.scan(words_in_pieces(body))
                counts.append(n)
                found.append([
                    {"label": known[t].label, "base": known[t].base, "start": b, "end": e, "score": scores[t]}
                    for b, e, t in sorted((b, e, t) for t, b, e in places)
                ])
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(counts, pa.int64()), pa.array(found, pa.list_(types))], ["row", "n_words", "places"])
        give_back()

    return df.mapInArrow(tag, schema)


def score_of(template: Template) -> float:
    """How sure the wording makes a label: the more words must match exactly, the nearer to 1."""
    m = mandatory_words(template.markup)
    return m / (m + SURE)
