"""License scans against plain regular expressions over the same words."""

import random
import re

import pytest

from jurybox.llm import licenses
from jurybox.llm.licenses import BASE, TEMPLATES, Automaton, Template, mandatory_words, parse, scan_licenses


def pattern(markup):
    out = ""
    for mark, low, high in parse(markup):
        out += {"[[": "(?:", "]]": ")?"}.get(mark) or (f" {mark}" if mark else f"(?: [^ ]+){{{low},{high}}}")
    return re.compile(out + "(?= )")


def text_of(rng, markup, slips):
    words, skip = [], False
    for mark, low, high in parse(markup):
        if mark in ("[[", "]]"):
            skip = mark == "[[" and rng.random() < 0.5
        elif not skip and mark:
            words.append(mark if rng.random() > slips else "other")
        elif not skip:
            words += [rng.choice(["x", "the", "permission", "license"]) for _ in range(rng.randint(max(0, low - 1), high + 1))]
    return words


def test_accepts_what_patterns_accept():
    rng = random.Random(3)
    known = (*BASE, *TEMPLATES)
    automaton = Automaton(known)
    patterns = [pattern(t.markup) for t in known]
    for _ in range(1500):
        words = [w for _ in range(3) for w in text_of(rng, rng.choice(known).markup, 0.004) + ["a"] * rng.randint(0, 2)]
        cut = sorted(rng.sample(range(len(words) + 1), 2))
        as_bytes = [w.encode() for w in words]
        n, places = automaton.scan(iter([as_bytes[:cut[0]], as_bytes[cut[0]:cut[1]], as_bytes[cut[1]:]]))
        line = " " + " ".join(words) + " "
        accepted = {i for i, p in enumerate(patterns) if p.search(line)}
        assert n == len(words) and {p[0] for p in places} == accepted
        for t, begin, end in places:
            place = " " + " ".join(words[begin:end]) + " "
            assert patterns[t].match(place).end() == len(place) - 1


def scanned(df, **options):
    return [(r["row"]["doc_id"], r["n_words"], [(p["label"], p["base"], p["start"], p["end"]) for p in r["places"]])
            for r in scan_licenses(df, **options).collect()]


def test_places(documents):
    long = "word " * 400_000 + "Released under the MIT License. " + "word " * 10
    rows = [
        (1, "The MIT-License, the mit\nlicense!"), (2, None), (3, ""), (4, "GENERAL PUBLIC LICENSE"), (4, "GENERAL PUBLIC LICENSE"),
        (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under the Apache License, Version 2.0."), (7, "Lizenz é MIT License"),
        (8, "permission is hereby granted"), (9, long), (10, "mit licenses, emit license"), (11, "copyright (c) 2020 A. B. all rights reserved"),
    ]
    got = dict((g[0], g[1:]) for g in scanned(documents(rows)))
    assert got[1] == (6, [("mit", True, 1, 3), ("mit", True, 4, 6)])
    assert got[2] == got[3] == (0, [])
    assert got[4] == (3, [("gpl", True, 0, 3)])
    assert got[5] == (7, [("CC-BY-NC-4.0", False, 0, 7)])
    assert ("apache", True, 3, 5) in got[6][1] and ("Apache-2.0", False, 0, 8) in got[6][1]
    assert got[7] == (4, [("mit", True, 2, 4)])
    assert got[8] == (4, [])
    assert got[9][0] == 400_015 and got[9][1] == [("MIT", False, 400_000, 400_005), ("mit", True, 400_003, 400_005)]
    assert got[10] == (4, [])
    assert got[11][1] == [("Proprietary", False, 0, 8)]
    assert len(scanned(documents(rows))) == len(rows) and scanned(documents([])) == []


def test_markup():
    assert mandatory_words("a [[b c]] {{1-3}} d") == 2
    for bad in ("a [[b", "a ]] b", "[[a]]", "{{1-2}} a", "a [[b [[c]] d]]", "a {{3-1}}"):
        with pytest.raises(ValueError):
            Automaton([Template("x", bad)])
    own = Automaton([Template("x", "a [[b]] {{0-2}} c")])
    for line, end in (("a c", 2), ("a b c", 3), ("a b z z c", 5), ("a z z c", 4), ("a z z z c", None)):
        _, places = own.scan(iter([[w.encode() for w in line.split()]]))
        assert [p[2] for p in places] == ([end] if end else [])
    assert licenses.score_of(BASE[0]) < licenses.score_of(BASE[2]) < max(map(licenses.score_of, TEMPLATES)) < 1
