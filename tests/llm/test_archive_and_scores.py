import numpy as np
import pyarrow as pa
import pytest
import xxhash

from jurybox.llm import lm_score, warc_fixity


@pytest.fixture
def pages(table):
    def make(n):
        ids = [None if i == 4 else i for i in range(n)]
        return table({"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}, page_id=ids, url=[f"http://x/{i}" for i in range(n)],
                     html=[None if i % 7 == 0 else f"page {i} " * (i % 50) for i in range(n)], node=[1] * n, hash=["h"] * n)

    return make


def test_record_round_trip():
    record = warc_fixity.warc_record(7, "http://a b\r\n/", "é\r\n\r\nx".encode())
    headers, payload = warc_fixity.read_record(record)
    assert headers["WARC-Record-ID"] == "<urn:page:7>" and payload.decode() == "é\r\n\r\nx" and "\n" not in headers["WARC-Target-URI"]
    assert record == warc_fixity.warc_record(7, "http://a b\r\n/", "é\r\n\r\nx".encode())


def test_audit(pages, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FILE_BYTES", 4000)
    files = warc_fixity.archive(pages(400))
    tree = warc_fixity.build_tree(files)
    assert warc_fixity.audit(tree, warc_fixity.build_tree(files)).count() == 0
    found = warc_fixity.audit(tree, warc_fixity.build_tree(warc_fixity.decay(files, 20, 31))).collect()
    want = {(i, "missing" if i % 31 == 3 else "corrupt") for i in range(400) if i != 4 and (i % 31 == 3 or i % 20 == 5)}
    assert {(r.record_id, r.status) for r in found} == want and len(found) == len(want)
    back = warc_fixity.audit(warc_fixity.build_tree(warc_fixity.decay(files, 10**6, 31)), tree).collect()
    assert {(r.record_id, r.status) for r in back} == {(i, "extra") for i in range(400) if i % 31 == 3} | {(5, "corrupt")}


def test_audit_of_empty(pages):
    empty, full = (warc_fixity.build_tree(warc_fixity.archive(pages(n))) for n in (0, 9))
    assert warc_fixity.audit(empty, empty).count() == 0
    assert {r.status for r in warc_fixity.audit(full, empty).collect()} == {"missing"}
    assert warc_fixity.audit(full, empty).count() == 9


def logs(frame):
    return sorted(((r.doc_id, r.n_words, r.pll) for r in frame.collect()), key=str)


def test_lm_learns_both_sides(documents):
    rng = np.random.default_rng(0)
    order = ["the cat sat on the mat and the dog ran to the old house by the sea".split() for _ in range(300)]
    train = [(i, " ".join(w)) for i, w in enumerate(order)]
    model = lm_score.fit(documents(train))
    mixed = [" ".join(rng.permutation(order[0])) for _ in range(20)]
    held = [(1, " ".join(order[0])), (2, None), (3, ""), (1, " ".join(order[0]))] + [(10 + i, t) for i, t in enumerate(mixed)]
    got = lm_score.score(documents(held), model).collect()
    good = [r for r in got if r.doc_id == 1]
    bad = [r for r in got if r.doc_id >= 10]
    assert good[0].pll == good[1].pll and max(r.perplexity for r in good) < 0.5 * min(r.perplexity for r in bad)
    assert [(r.n_words, r.pll, r.perplexity) for r in got if r.doc_id in (2, 3)] == [(0, 0.0, None)] * 2
    # better than counts of words alone
    total = sum(len(w) for w in order)
    counts = {w: sum(x.count(w) for x in order) for w in order[0]}
    alone = -sum(np.log(counts[w] / total) for w in order[0]) / len(order[0])
    assert np.log(good[0].perplexity) < 0.5 * alone


def plain_scores(rows, frequent, counts, totals, flat):
    """Every document by itself, word by word, with plain softmax over all classes."""
    net = lm_score.Network.of(flat)
    out = []
    for doc_id, text in rows:
        words, pll = (text or "").lower().split(), 0.0
        hashes = [np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64) for w in words]
        rank = {w: i for i, w in enumerate(frequent.tolist())}
        kinds = [rank.get(h, lm_score.FREQUENT + xxhash.xxh3_64_intdigest(w[-2:]) % lm_score.ENDINGS) for h, w in zip(hashes, words)]
        for i, kind in enumerate(kinds):
            near = [kinds[j] if 0 <= j < len(kinds) else lm_score.SIZE for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(net.hidden + sum(net.embed[p * (lm_score.SIZE + 1) + k] for p, k in enumerate(near)))
            g, m = divmod(kind, lm_score.SIDE)
            group, member = h @ net.top + net.top_bias, h @ net.low[g] + net.low_bias[g]
            p = np.exp(group[g]) / np.exp(group).sum() * np.exp(member[m]) / np.exp(member).sum()
            pll += np.log(p) + np.log(max(counts.get(hashes[i], 0), 1) / (totals[kind] + 1))
        out.append((doc_id, len(words), pll))
    return sorted(out, key=str)


def test_lm_equals_plain_form(documents, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 3000)
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(names[int(x)] for x in rng.zipf(1.3, 60) % 2000)) for i in range(150)]
    rows += [(7, rows[7][1]), (None, "É ß a\tb\u00a0c"), (300, "tie " * 5 + "tied " * 5), (301, " ".join(names * 10)), (302, None), (303, "")]
    model = lm_score.fit(documents(rows))
    assert len(model.words.frequent) == lm_score.FREQUENT and (model.words.totals[lm_score.FREQUENT:] > 0).any()
    counts = {r.word: r.n for r in model.words.counts.collect()}
    assert sum(counts.values()) == model.words.totals.sum() == sum(len((t or "").replace("\u00a0", "_").split()) for _, t in rows)
    fresh = rows + [(400, "never seen before w1 w2")]
    plain = plain_scores([(i, t and t.replace("\u00a0", "_")) for i, t in fresh if i is not None], *(
        model.words.frequent, counts, model.words.totals, model.flat))
    got = [r for r in logs(lm_score.score(documents(fresh), model)) if r[0] is not None]
    assert [r[:2] for r in got] == [r[:2] for r in plain]
    assert np.allclose([r[2] for r in got], [r[2] for r in plain], rtol=1e-4, atol=1e-4)


def test_lm_same_for_any_partitions(documents, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 500)
    rows = [(i, " ".join(f"v{(i * j) % 37}" for j in range(40))) for i in range(120)]
    one, many = (logs(lm_score.fit_and_score(documents(rows).repartition(n))) for n in (1, 8))
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2] for r in one], [r[2] for r in many], rtol=1e-6)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    net = lm_score.Network.of(rng.normal(0, 0.5, sum(int(np.prod(s)) for s in lm_score.SHAPES.values())))
    near = rng.integers(0, lm_score.SIZE + 1, (lm_score.PLACES, 1)).astype(np.int16)
    every = np.arange(lm_score.SIZE, dtype=np.int16)
    assert abs(np.exp(net.log_likelihood(every, np.repeat(near, lm_score.SIZE, axis=1))).sum() - 1) < 1e-4


def test_lm_empty(documents):
    model = lm_score.fit(documents([]))
    assert len(model.words.frequent) == 0 and lm_score.score(documents([]), model).count() == 0
    assert lm_score.score(documents([(1, "a b")]), model).first().n_words == 2


def test_contexts_stay_in_documents():
    near = lm_score.contexts(np.array([1, 2, 3, 4]), np.array([0, 2, 2, 4]))
    none = lm_score.SIZE
    assert near.T.tolist() == [[none, none, 2, none], [none, 1, none, none], [none, none, 4, none], [none, 3, none, none]]
