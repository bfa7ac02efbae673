import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jurybox.llm import decontaminate as dc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP)) if w]


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= x
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


def result(documents, table, texts, items):
    bench = table({"item_id": pa.int64(), "text": pa.string()}, item_id=[i for i, _ in items], text=[t for _, t in items], n=[1] * len(items))
    rows = dc.mark_contaminated(documents(list(enumerate(texts))), bench).collect()
    return [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in sorted(rows, key=lambda r: r.row.doc_id)]


LONG = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize("limit", [dc.MAX_BROADCAST_WINDOWS, 0])
def test_edges(documents, table, monkeypatch, limit):
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", limit)
    items = [(1, LONG), (2, "short item"), (3, None), (4, ""), (5, "Éa a b"), (6, LONG), (10, "x y z " * 5)]
    texts = [None, "", LONG, "a " + LONG.upper() + " b", " ".join(LONG.split()[5:14]), " ".join(LONG.split()[5:15]), "a SHORT-item, short item",
             "éa a b", "Éa a b", "x y z " * 400, "q " * 20000 + LONG]
    assert result(documents, table, texts, items) == brute(texts, items)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join), min_size=1, max_size=6),
       st.lists(st.lists(st.sampled_from("ab"), max_size=14).map(" ".join), max_size=4))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random(documents, table, texts, items):
    items = list(enumerate(items))
    assert result(documents, table, texts, items) == brute(texts, items)


def test_empty_and_repeats(documents, table):
    assert result(documents, table, [], [(1, LONG)]) == []
    assert result(documents, table, ["a b"], []) == [(2, 0, [], False)]
    bench = table({"item_id": pa.int64()}, item_id=[1], text=[LONG])
    df = documents([(1, LONG), (1, LONG), (None, LONG), (1, "clean")])
    assert sorted(r.n_hit for r in dc.mark_contaminated(df, bench).collect()) == [0, 30, 30, 30]
    left = dc.drop_contaminated(df, bench)
    assert left.columns == df.columns and [r.text for r in left.collect()] == ["clean"]
