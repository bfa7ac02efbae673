import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from jurybox.llm.queries import QUERIES, vocabulary
from tests.llm import test_decontaminate as decon
from tests.llm import test_jaccard_join as near

GOOD = "the cat and the dog were in a house by the sea with a lot of old books on it"


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(GOOD.split()) if i % 3 else f"w{rng.integers(0, 5000)}" for i in range(n))


@pytest.fixture
def folder(tmp_path):
    item = prose(99, 30)
    texts = [prose(1), prose(1), prose(1) + " tail", "short", None, "", prose(2) + " " + item, prose(3) + " mail a.b@c.de end", "### " * 30 + prose(4),
             prose(5), prose(6, 4000)]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n,
                             "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    return str(tmp_path), texts, item


def test_stages(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        rows = docs.collect()
        kept.append({r.doc_id for r in rows})
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in rows)
            assert [r.text for r in rows if r.doc_id == 7] == [texts[7].replace("a.b@c.de", "[EMAIL]")]
        if name != "best_fit_packing":
            assert docs.columns == columns and len(rows) == len(kept[-1])
    assert kept == [{0, 1, 2, 6, 7, 9, 10}, {0, 6, 7, 9, 10}, {0, 7, 9, 10}, {0, 7, 9, 10}, {0, 7, 9, 10}]


def test_run_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path, texts, item = folder
    good = [i for i, t in enumerate(texts) if t and len(t.split()) >= 10 and t.count("#") <= 0.25 * len(t.split())]
    good = [i for i, _, c in near.brute([(i, texts[i]) for i in good], 5, 80) if c == i]
    good = [i for i, r in zip(good, decon.brute([texts[i] for i in good], [(1, item)])) if not r[3]]
    want = set()
    encoder = Tokenizer.from_file(vocabulary())
    for i in good:
        ids = encoder.encode(re.sub(r"\S+@\S+", "[EMAIL]", texts[i]), add_special_tokens=False).ids + [0]
        want |= {(i, p // 2048, p, len(ids[p:p + 2048]), zlib.crc32(np.array(ids[p:p + 2048], dtype="<u4").tobytes())) for p in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
