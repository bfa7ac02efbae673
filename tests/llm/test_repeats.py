import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jurybox.llm import repeats


def brute(rows, length):
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(data[s:s + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(documents, texts, length=100):
    rows = list(enumerate(texts))
    got = repeats.remove_repeats(documents(rows), length=length)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert got == brute(rows, length)


RNG = np.random.default_rng(1)
A, B, C = ("".join(chr(c) for c in RNG.integers(97, 123, 400)) for _ in range(3))


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_edges(documents, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    check(documents, [
        None, "", "short", A, A, A[:99], A[:100], "x" + A[50:150] + "y", B + A[100:300], A[:99] + "!" + A[100:], C[:150] + C[:150] + C[100:220],
        "z" * 350, "ab" * 200, "é𝄞" * 120, "\x00" * 130, B[200:] + B[:200], C * 20,
    ])


@given(st.lists(st.lists(st.sampled_from([A[:60], A[60:130], B[:45], "ab", "q"]), max_size=12).map("".join), min_size=1, max_size=8))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random(documents, texts):
    check(documents, texts)


def test_repeat_groups(documents):
    df = documents([(1, B + A[:200] + "1"), (2, C + A[:200] + "2"), (3, A[:150] + "3")])
    groups = {}
    for r in repeats.repeat_groups(df).collect():
        groups.setdefault((r.bucket, r.repeat), []).append((r.doc_id, r.start, r.length))
    texts = {1: B + A[:200] + "1", 2: C + A[:200] + "2", 3: A[:150] + "3"}
    assert groups
    for rows in groups.values():
        assert len(rows) > 1 and len({texts[d][s:s + n] for d, s, n in rows}) == 1 and all(n >= 100 for _, _, n in rows)
    assert any({d for d, _, _ in rows} == {1, 2, 3} for rows in groups.values())


def test_interval_tree():
    texts = [b"0" + b"x" * 3 + b"abcdefgh" * 2 + b"1", b"1" + b"x" * 3 + b"abcdefgh" * 2 + b"2", b"2" + b"x" * 3 + b"abcdefgh" + b"?"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    own = np.array([len(t) - 9 for t in texts])
    owner, at, before, lcp = repeats.suffix_intervals(data, bounds, own, 10)
    found = {(tuple(sorted(zip(owner[a:b].tolist(), at[a:b].tolist()))), n) for a, b, n in repeats.maximal_repeats(lcp, before)}
    assert ((((0, 1), (1, 1), (2, 1))), 11) in found and (((0, 1), (1, 1)), 19) in found


def test_ids(documents):
    df = documents([(None, A), (1, A), (1, A), (2, A), (1, B)])
    rows = sorted(((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect()), key=str)
    assert rows == sorted([(None, 0), (1, 0), (1, 0), (2, 400), (1, 0)], key=str)
    assert repeats.remove_repeats(documents([])).count() == 0


def test_repeated_rows_and_a_third_document(documents):
    rows = [(5, A), (5, A), (9, "xx" + A + B)]
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(documents(rows)).collect())
    assert got == [(5, 0), (5, 0), (9, 400)]
