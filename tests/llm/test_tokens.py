import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jurybox.llm import packing, token_files, tokens
from jurybox.llm.common import scratch
from jurybox.llm.queries import vocabulary

TEXTS = [None, "", "  ", "one", "The the THE, the.", "é É ß ÇA don't it's", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "𝄞     á Σς ΑΣ",
         "w" * 3000, "a b " * 4000, "\x00\x1c\x1f", "१२३ 中文字 한국"]


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(texts):
    ids, bounds = tokens.encoder(vocabulary()).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_RUNS", 5)
    for _ in range(3):
        assert encoded(TEXTS) == whole(TEXTS)
    assert encoded([]) == []


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_random(texts):
    assert encoded(texts) == whole(texts)


def test_chunks_are_plain_copies():
    batch = pa.record_batch({"text": ["ab", None, "C" * 10, "d"]})
    parts = list(tokens.chunks(batch, "text", 3))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.column("text").offset == 0 for p in parts) and len(parts) > 1


def test_token_files(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)][::-1] + [(3, "one"), (None, "null id")]
    path = scratch(spark, "tokens")
    token_files.write_tokens(documents(rows), path, vocabulary(), 1)
    got = token_files.checksums(token_files.read_tokens(spark, path)).collect()
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole([text])[0] + [1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert "ids" not in token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_token_file_layout(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/t"
    token_files.write_tokens(documents([(i, "a b c " * 50) for i in range(300)]), path, vocabulary(), 1)
    column = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    encodings = {column.column(i).path_in_schema: column.column(i).encodings for i in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in encodings["ids.list.element"]) and "DELTA_BINARY_PACKED" in encodings["doc_id"]
    assert column.column(0).has_column_index and column.column(0).has_offset_index


def test_token_files_empty(spark, documents):
    path = scratch(spark, "tokens")
    token_files.write_tokens(documents([]), path, vocabulary(), 1)
    assert token_files.read_tokens(spark, path).count() == 0


def greedy(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, used = packing.plan(counts, 20)
    placed = defaultdict(list)
    ranks = defaultdict(list)
    for n, rank, pieces, first, offset in runs:
        for k in range(pieces):
            placed[first + k].append((offset, n))
            ranks[n].append(rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert len(placed) == used == greedy(lengths, 20)
    for row in placed.values():
        end = 0
        for offset, n in sorted(row):
            assert offset == end
            end += n
        assert end <= 20


@pytest.mark.parametrize("capacity", [7, 2048])
def test_pack(documents, capacity):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "null id")] + [(100 + i, "same copy") for i in range(50)]
    packed = packing.pack(documents(rows), vocabulary(), 0, capacity, with_ids=True)
    got = packed.collect()
    want = []
    for i, text in rows:
        ids = whole([text])[0] + [0]
        want += [(i, p // capacity, p, len(ids[p:p + capacity]), crc(ids[p:p + capacity])) for p in range(0, len(ids), capacity)]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for row in places.values():
        assert sum(n for _, n in row) <= capacity and all(o == sum(n for _, n in sorted(row)[:k]) for k, (o, _) in enumerate(sorted(row)))
    assert len(places) == greedy([w[3] for w in want], capacity)
    joined = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(w[3] for w in want)
    assert packing.pack(documents([]), vocabulary(), 0).count() == 0
