import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jurybox.llm import jaccard_join as jj
from jurybox.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UP)) if x]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, threshold):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def found(df, n, threshold):
    return sorted(map(tuple, jj.near_duplicates(df, n, threshold).collect()))


def variants(seed, words, copies, edits):
    rng = np.random.default_rng(seed)
    base = [f"t{seed}w{i}" for i in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for k in rng.integers(0, words, edits):
            text[k] = f"e{rng.integers(0, 6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("n,threshold,group", [(3, 90, jj.MAX_GROUP), (5, 80, jj.MAX_GROUP), (3, 90, 3), (5, 80, 2)])
def test_variants(documents, monkeypatch, n, threshold, group):
    monkeypatch.setattr(jj, "MAX_GROUP", group)
    texts = [None, "", " \n", "one", "ONE", "two words", "Two  words", "a b c", "a b c d"]
    texts += variants(1, 120, 9, 2) + variants(2, 60, 8, 1) + variants(3, 200, 6, 5) + ["same text here again"] * 5 + ["x y " * 3000, "x y " * 2000]
    rows = list(enumerate(texts))
    assert found(documents(rows), n, threshold) == brute(rows, n, threshold)


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=14).map(" ".join), min_size=1, max_size=14))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random(documents, texts):
    rows = list(enumerate(texts))
    assert found(documents(rows), 2, 60) == brute(rows, 2, 60)


def test_group_links_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        m, threshold = 12, int(rng.choice([60, 80, 90]))
        base = rng.choice(60, 30, replace=False)
        raw = [np.unique(np.concatenate([rng.choice(base, 26, replace=False), rng.integers(100, 130, 3)])) for _ in range(m)]
        df = {v: sum(v in s for s in map(set, raw)) for s in raw for v in s}
        sets = [np.array(sorted((v for v in s if df[v] > 1), key=lambda v: (df[v], v)), dtype=np.int64) for s in raw]
        n = np.array([len(s) for s in raw])
        level = np.array([jj.choose_level(int(a), len(s), np.array([df[v] for v in s]), threshold) for a, s in zip(n, sets)])
        keys = [bytes([i]) for i in range(m)]
        got = jj.link_group(keys, n, level, sets, keys, threshold)
        rows = [(i, " ".join(map(str, s))) for i, s in enumerate(raw)]
        want = {i: c for i, _, c in brute(rows, 1, threshold)}
        label = {i: i for i in range(m)} | {b[0]: a[0] for a, b in got}
        assert label == want


def test_heavy_shingles(documents, monkeypatch):
    monkeypatch.setattr(jj, "HEAVY_PART", 2)
    rows = list(enumerate(variants(4, 50, 20, 1)))
    assert found(documents(rows), 3, 90) == brute(rows, 3, 90)


def test_repeated_and_null_ids(documents):
    long = " ".join(f"w{i}" for i in range(40))
    df = documents([(5, long), (2, long), (2, "other text of some words"), (9, "other text of some words"), (None, long), (7, None), (2, long)])
    got = jj.near_duplicates(df, 3, 90).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (9, 2), (None, None), (7, 7)}
    kept = jj.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, None]
    assert jj.near_duplicates(documents([]), 3, 90).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_copies_in_many_tasks(documents):
    """Copies of frequent classes asked for by several tasks count once."""
    texts = (variants(1, 120, 5, 2) + variants(4, 120, 4, 9)) * 6
    rows = list(enumerate(texts))
    assert found(documents(rows).repartition(5), 3, 90) == brute(rows, 3, 90)
    assert found(documents(rows).repartition(5), 3, 70) == brute(rows, 3, 70)
