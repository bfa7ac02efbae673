"""Metrics, slices, calibration and order statistics against plain Python."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jurybox.operators import order, samples, scores, telemetry


def plain_metrics(pairs):
    labels = {g for g, _ in pairs} | {p for _, p in pairs if p is not None}
    f1 = []
    for k in labels:
        tp = sum(g == k and p == k for g, p in pairs)
        fp = sum(g != k and p == k for g, p in pairs)
        fn = sum(g == k and p != k for g, p in pairs)
        f1.append(2 * tp / (2 * tp + fp + fn))
    return sum(g == p for g, p in pairs) / len(pairs), sum(f1) / len(f1)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 5]), rng.choice([0, 1, 2, None]), f"m{rng.randrange(3)}", rng.randrange(101) / 100) for _ in range(500)]
    return rows, spark.createDataFrame(rows, "gold bigint, pred int, model_id string, confidence double")


def test_metrics(scored):
    rows, df = scored
    row = scores.classification_metrics(df).first()
    accuracy, f1 = plain_metrics([r[:2] for r in rows])
    assert row["n"] == 500 and row["accuracy"] == pytest.approx(accuracy) and row["macro_f1"] == pytest.approx(f1)
    weighted = df.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    assert scores.classification_metrics(weighted).first() == row
    for r in scores.error_slices(df, ["model_id", "gold"]).collect():
        mine = [x[:2] for x in rows if (x[2] if r["slice"] == "model_id" else str(x[0])) == r["value"]]
        assert (r["n"], r["accuracy"], r["macro_f1"]) == (len(mine), *map(pytest.approx, plain_metrics(mine)))


def test_confusion(scored):
    rows, df = scored
    got = {(r["gold"], r["pred"]): r["n"] for r in scores.confusion_matrix(df).collect()}
    assert got == {k: sum(x[:2] == k for x in rows) for k in {x[:2] for x in rows}}
    wide = {r["gold"]: r for r in scores.confusion_wide(df).collect()}
    assert wide[0]["pred_null"] == got[0, None] and wide[2]["pred_1"] == got[2, 1]
    assert len(scores.metrics_table(df).first()["confusion_matrix"]) == len(got)


def test_calibration(scored):
    rows, df = scored
    bins = {r["bin"]: r for r in scores.calibration_bins(df).collect()}
    for b, r in bins.items():
        mine = [x for x in rows if min(int(x[3] * 10), 9) == b]
        assert r["n"] == len(mine) and r["mean_confidence"] == pytest.approx(sum(x[3] for x in mine) / len(mine))
    ece = sum(r["n"] / 500 * abs(r["accuracy"] - r["mean_confidence"]) for r in bins.values())
    assert scores.expected_calibration_error(scores.calibration_bins(df)).first()["ece"] == pytest.approx(ece)
    model = scores.fit_calibration(df)
    fitted = [r["calibrated"] for r in scores.calibrate(model, scores.confidence_table(df)).orderBy("confidence").collect()]
    assert fitted == sorted(fitted) and 0 <= fitted[0] <= fitted[-1] <= 1


def one_pass(points):
    """Pool adjacent violators over (confidence, n, right), by fractions."""
    out = []
    for c, n, right in points:
        out.append([c, c, n, right])
        while len(out) > 1 and Fraction(out[-2][3], out[-2][2]) >= Fraction(out[-1][3], out[-1][2]):
            low, _, m, r = out.pop(-2)
            out[-1] = [low, out[-1][1], out[-1][2] + m, out[-1][3] + r]
    return [tuple(b) for b in out]


@pytest.mark.parametrize("noise", [0, 300, 10_000_000])
def test_calibration_of_a_million_confidences(spark, noise):
    size = 1_000_000 if noise == 300 else 20_000
    spread = F.when(F.lit(noise) > 0, F.pmod(F.xxhash64("id"), F.lit(max(noise, 1)))).otherwise(F.lit(0))
    rows = spark.range(size).select((F.col("id") / size).alias("confidence"), F.lit(1000).alias("n"),
                                    (F.least(F.col("id") + spread, F.lit(size)) * 1000 / size).cast("bigint").alias("hits"))
    counted = rows.select("confidence", F.inline(F.array(
        F.struct(F.lit(1).alias("gold"), F.lit(1).alias("pred"), F.col("hits").alias("n")),
        F.struct(F.lit(1).alias("gold"), F.lit(0).alias("pred"), (F.lit(1000) - F.col("hits")).alias("n")))))
    got = [tuple(r) for r in scores.fit_calibration(counted.repartition(7), fan=2).select("low", "high", "n", "right").orderBy("low").collect()]
    if size == 20_000:
        want = one_pass([(r["confidence"], 1000, r["hits"]) for r in rows.orderBy("confidence").collect()])
    else:
        want = scores.pool((r["confidence"], r["confidence"], 1000, r["hits"]) for r in rows.orderBy("confidence").toLocalIterator())
    assert got == want


def test_calibrated_between_and_outside(spark, monkeypatch):
    monkeypatch.setattr(scores, "CHUNK", 2)
    blocks = [(i, i / 10 + 0.01, i / 10 + 0.05, 10, i, i / 10) for i in range(7)]
    fitted = spark.createDataFrame(blocks, "seq bigint, low double, high double, n bigint, right bigint, calibrated double")
    at = [-1.0, 0.01, 0.03, 0.05, 0.08, 0.2, 0.4, 0.61, 0.63, 0.65, 0.9, None]
    df = spark.createDataFrame([(x,) for x in at], "confidence double")
    knots = [(v, b[5]) for b in blocks for v in (b[1], b[2])]
    got = {r["confidence"]: r["calibrated"] for r in scores.calibrate(fitted, df).collect()}
    assert got.pop(None) is None and len(got) == len(at) - 1
    for x, y in got.items():
        assert y == pytest.approx(float(np.interp(x, *zip(*knots))))
    nothing = scores.calibrate(fitted.limit(0), df)
    assert {r["calibrated"] for r in nothing.collect()} == {None}


def test_gold_rows_count(spark):
    e = spark.createDataFrame([("q", "d", 1, 1.0), ("q", "e", 0, 0.5)], "query_id string, docid string, final_label int, final_confidence double")
    g = spark.createDataFrame([("q", "d", 1), ("q", "d", 1), ("q", "d", 2), ("q", "x", 0)], "query_id string, docid string, gold_relevance bigint")
    got = {(r["gold"], r["pred"]): r["n"] for r in scores.join_gold(e, g).collect()}
    assert got == {(1, 1): 2, (2, 1): 1}


SHAPES = {
    "uniform": lambda r: r.uniform(0, 1000),
    "few values": lambda r: float(r.randrange(4)),
    "one value": lambda r: 7.0,
    "far outliers": lambda r: r.choice([r.uniform(0, 1), 1e12 * r.random(), -1e9]),
    "close together": lambda r: 1.0 + r.randrange(40) * 2.0 ** -52,
    "both signs": lambda r: r.choice([-1.0, 1.0]) * r.choice([0.0, 5e-324, 1.5, 1e300, r.random()]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_percentiles_by_rank(spark, shape):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), SHAPES[shape](rng)) for _ in range(2000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p95": 0.95, "p100": 1.0}
    extra = [F.count("v").alias("n")]
    at = [F.percentile("v", p).alias(k) for k, p in points.items()]
    plain = {r["k"]: r.asDict() for r in df.groupBy("k").agg(*extra, *at).collect()}
    ranked = {r["k"]: r.asDict() for r in order.percentiles(df, "v", points, ["k"], extra).collect()}
    assert set(plain) == {"a", "b", None, "one", "none"} == set(ranked)
    assert ranked == plain  # in every bit
    for k, want in plain.items():
        values = [v for g, v in rows if g == k and v is not None]
        if values:
            assert want["p95"] == pytest.approx(np.quantile(values, 0.95))


def test_percentiles_of_one_far_value(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000 / 30_000).alias("v")).union(spark.sql("SELECT 1e12D"))
    points = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = df.agg(*[F.percentile("v", p).alias(k) for k, p in points.items()]).first()
    assert order.percentiles(df, "v", points).first() == want


def test_ranks_of_integers_and_outside(spark):
    df = spark.range(1 << 60, (1 << 60) + 500).select("id")
    total = F.col("_total")
    got = order.order_statistics(df, "id", {"low": F.lit(0), "mid": F.lit(250), "top": total - 1, "over": total, "under": F.lit(-1)}).first()
    assert tuple(got) == (1 << 60, (1 << 60) + 250, (1 << 60) + 499, None, None)


def test_describe_is_that_of_pandas(spark):
    values = [float(x % 97) / 3 for x in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms double")
    want = pd.Series(values).describe()
    nothing = telemetry.describe_latency(df.limit(0)).collect()
    assert [(r["count"], r["p50"]) for r in nothing] == [(0, None)]
    got = telemetry.describe_latency(df).first()
    assert [got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want))


def test_smallest_beyond_one_task(spark, monkeypatch):
    df = spark.range(0, 3000, 3).select(F.col("id").alias("line_no")).repartition(5)
    monkeypatch.setattr(order, "ONE_TASK_ROWS", 10)
    for n in (11, 999, 1000, 5000):
        assert sorted(r[0] for r in samples.limit_samples(df, n).collect()) == list(range(0, 3000, 3))[:n]
    for n in (0, 5, -1, -999, -1000, -2000):
        assert sorted(r[0] for r in samples.limit_examples(df, n).collect()) == list(range(0, 3000, 3))[:n]


def test_limits_run_nothing_before_they_are_asked(spark):
    failing = spark.range(100).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("evaluated")).cast("bigint")).alias("line_no"))
    for limited in (samples.limit_examples(failing, -3), samples.limit_samples(failing, 5000)):
        with pytest.raises(Exception, match="evaluated"):
            limited.collect()


def test_run_tables(spark):
    logs = spark.createDataFrame(
        [("r1", "started", "info", None), ("r1", "inference_success", "info", 100.0), ("r1", "inference_success", "info", 700.0), ("r2", "failed", "error", None)],
        "run_id string, event string, level string, latency_ms double",
    ).withColumn("timestamp", F.lit("2025-01-01").cast("timestamp"))
    report = {r["run_id"]: r for r in telemetry.run_report(logs).collect()}
    assert report["r1"]["entries"] == 3 and report["r1"]["events"] == ["inference_success", "started"]
    assert telemetry.count_errors(logs).first()[0] == 1
    assert telemetry.mean_latency(logs).first()[0] == 400.0
    assert telemetry.filter_events(logs, min_latency_ms=500).count() == 1
    assert telemetry.filter_events(logs, event="failed", level="error", run_id="r2").count() == 1


def test_checksum(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    a, b = telemetry.dataset_checksum(df).first(), telemetry.dataset_checksum(df.repartition(7)).first()
    assert a == b and a["n_rows"] == 1000
    assert telemetry.dataset_checksum(df.union(df.limit(1)).union(df.limit(1))).first()["checksum"] != a["checksum"]
    assert tuple(telemetry.dataset_checksum(df.limit(0)).first()) == (0, 0)
    rows = [("a", None), ("a", ""), (None, "a"), ("aV1:b", "c"), ("a", "V1:b")]
    sums = [telemetry.dataset_checksum(spark.createDataFrame([r], "x string, y string")).first()["checksum"] for r in rows]
    assert len(set(sums)) == len(rows)
    plain = sum(int(hashlib.md5(f"V{len(str(i))}:{i}V1:{i % 3}".encode()).hexdigest()[:16], 16) for i in range(1000)) % (1 << 64)
    assert a["checksum"] == plain
