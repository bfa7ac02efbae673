"""Votes, agreement and disagreement against plain Python."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from jurybox.operators import votes
from jurybox.sources import registry

SCHEMA = "query_id string, docid string, model_id string, label int, confidence double, warnings array<string>, run_id string"


def judged(spark, rows):
    full = [(r[0], r[1], r[2], r[3], 0.5, r[4] if len(r) > 4 else [], r[5] if len(r) > 5 else "r1") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_pair(df):
    return {(r["query_id"], r["docid"]): r for r in df.collect()}


def test_rules(spark):
    rows = [
        ("q", "tie", "a", 2), ("q", "tie", "b", 1), ("q", "tie", "c", None, ["w"]),
        ("q", "all", "a", 2), ("q", "all", "b", 2), ("q", "all", "c", 2),
        ("q", "none", "a", None, ["w"]), ("q", "none", "b", None), ("q", "none", "c", None),
        ("q", "split", "a", 0), ("q", "split", "b", 1), ("q", "split", "c", 2),
    ]
    samples = spark.createDataFrame([("q", d) for d in ("tie", "all", "none", "split", "unseen", "all")], "query_id string, docid string")
    got = by_pair(votes.majority_vote(judged(spark, rows), samples=samples))
    assert {d: (r["final_label"], round(r["final_confidence"], 4), r["flags"]) for (_, d), r in got.items()} == {
        "tie": (1, 0.5, ["tie", "parser_fallback", "partial_votes"]),
        "all": (2, 1.0, []),
        "none": (None, 0.0, ["parser_fallback", "no_valid_votes"]),
        "split": (0, 0.3333, ["tie", "low_agreement"]),
        "unseen": (None, 0.0, ["no_valid_votes"]),
    }
    assert got["q", "all"]["sample_id"] == "q:all"
    assert [(v["model_id"], v["label"]) for v in got["q", "tie"]["per_model_votes"]] == [("a", 2), ("b", 1), ("c", None)]
    assert got["q", "unseen"]["per_model_votes"] == []
    assert got["q", "all"]["aggregation_strategy"]["name"] == "majority"


@pytest.mark.parametrize("as_table", [False, True])
def test_exact_weights(spark, as_table):
    """0.1 three times equals 0.3: no float sums."""
    weights = {"a": 0.1, "b": 0.1, "c": 0.1, "d": 0.3}
    rows = [("q", "d", m, 2) for m in "abc"] + [("q", "d", "d", 1)]
    given = registry.weights_df(spark, weights) if as_table else weights
    row = votes.vote(judged(spark, rows), given).first()
    assert row["final_label"] == 1 and row["final_confidence"] == 0.5 and "tie" in row["flags"]


def test_zero_weight_and_default(spark):
    rows = [("q", "d", "a", 2), ("q", "e", "a", 2), ("q", "e", "b", 1)]
    got = by_pair(votes.vote(judged(spark, rows), {"a": 0.0}, 2.0))
    assert (got["q", "d"]["final_label"], got["q", "d"]["final_confidence"]) == (2, 0.0)
    assert (got["q", "e"]["final_label"], got["q", "e"]["final_confidence"]) == (1, 1.0)


def test_latest_run_counts_once(spark):
    """Copies of one judgement by the thousand, and an older run, are one vote."""
    rows = [("q", "d", "a", 2, [], "r1")] * 3000 + [("q", "d", "a", 1, [], "r2")] * 3000 + [("q", "d", "b", 0, [], "r1")]
    row = votes.vote(judged(spark, rows)).first()
    assert [(v["model_id"], v["label"]) for v in row["per_model_votes"]] == [("a", 1), ("b", 0)]
    assert row["disagreement_metrics"]["n_votes"] == 2


def brute(rows, weights, default):
    groups = defaultdict(dict)
    for q, d, m, label in rows:
        groups[q, d][m] = label
    out = {}
    for pair, by_model in groups.items():
        total = defaultdict(Fraction)
        for m, label in by_model.items():
            if label is not None:
                total[label] += Fraction(str(weights.get(m, default)))
        if not total:
            out[pair] = (None, 0.0, None, None)
            continue
        best = max(total.values())
        valid = [x for x in by_model.values() if x is not None]
        share = [valid.count(x) / len(valid) for x in set(valid)]
        n = len(valid)
        same = sum(valid.count(x) * (valid.count(x) - 1) for x in set(valid))
        out[pair] = (
            min(k for k, w in total.items() if w == best), float(best / sum(total.values())),
            -sum(p * math.log2(p) for p in share), same / (n * (n - 1)) if n > 1 else None,
        )
    return out


def test_against_plain_python(spark):
    rng = random.Random(7)
    models = ["m%d" % i for i in range(5)]
    rows = [(f"q{i % 9}", f"d{i}", m, rng.choice([0, 1, 2, None])) for i in range(200) for m in models if rng.random() < 0.8]
    weights = {"m0": 1.5, "m1": 0.5, "m2": 0.25}
    df = judged(spark, rows)
    want = brute(rows, weights, 1.0)
    got = by_pair(votes.vote(df, weights))
    assert set(got) == set(want)
    for pair, (label, confidence, entropy, agreement) in want.items():
        r, m = got[pair], got[pair]["disagreement_metrics"]
        assert r["final_label"] == label and r["final_confidence"] == pytest.approx(confidence)
        assert m["vote_entropy"] == pytest.approx(entropy) and m["pairwise_agreement"] == pytest.approx(agreement)
    permuted = by_pair(votes.vote(df.repartition(9, "label"), weights))
    assert {k: v["per_model_votes"] for k, v in permuted.items()} == {k: v["per_model_votes"] for k, v in got.items()}

    labels = {(q, d, m): x for q, d, m, x in rows}
    pairs = {(r["model_a"], r["model_b"]): (r["n_both"], r["n_different"]) for r in votes.disagreement_pairs(df, models).collect()}
    assert len(pairs) == 10
    for (a, b), counts in pairs.items():
        both = [(labels.get((q, d, a)), labels.get((q, d, b))) for q, d in want]
        both = [(x, y) for x, y in both if x is not None and y is not None]
        assert counts == (len(both), sum(x != y for x, y in both))
    sets = by_pair(votes.disagreement_sets(df))
    for pair in want:
        valid = {x for (q, d, _), x in labels.items() if (q, d) == pair and x is not None}
        assert (pair in sets) == (len(valid) > 1)


def test_strategies(spark):
    assert votes.STRATEGIES["weighted_majority"] is votes.vote
    votes.register_strategy("first", lambda j, **_: j.select("query_id").limit(1))
    assert votes.STRATEGIES["first"](judged(spark, [("q", "d", "a", 1)])).count() == 1
    del votes.STRATEGIES["first"]


def test_large_panels(spark):
    """A thousand weights plan, and a hundred models are paired without a column per pair."""
    rows = [(f"q{i % 3}", f"d{i}", f"m{m:03}", (i + m) % 3) for i in range(12) for m in range(100)]
    df = spark.createDataFrame(rows, "query_id string, docid string, model_id string, label int")
    weighted = votes.attach_weight(df, {f"m{m:03}": m + 0.5 for m in range(1000)})
    assert {float(r["weight"]) for r in weighted.where("model_id = 'm007'").collect()} == {7.5}
    pairs = votes.disagreement_pairs(df).collect()
    assert len(pairs) == 100 * 99 // 2
    for r in pairs:
        same = (int(r["model_a"][1:]) - int(r["model_b"][1:])) % 3 == 0
        assert (r["n_both"], r["n_different"]) == (12, 0 if same else 12)
