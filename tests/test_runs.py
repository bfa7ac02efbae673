"""Readers, sinks and the four stages over a run directory, and the file stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jurybox import plans
from jurybox.operators import telemetry
from jurybox.sources import readers, registry, sinks
from jurybox.streaming import judge_new_samples

SAMPLE = {"dataset": "llm-judge-2024", "query_id": "q1", "query_text": "té\nxt", "docid": "d1", "doc": "a", "gold_relevance": 1}
GIT = {"git_sha": "c0ffee1", "git_clean": True, "git_branch": "main"}


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "llm4eval_query_2024.txt").write_text("q1\tWhat is AI?\n\nq2\tDefine ML\n", encoding="utf-8")
    docs = [{"docid": "d1", "doc": "AI is..."}, {"docid": "d2", "doc": "ML is..."}]
    (root / "llm4eval_document_2024.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs), encoding="utf-8")
    (root / "llm4eval_test_qrel_2024.txt").write_text("q2 2 d2\nq1 1 d1\nq1 0 d2\nq3 1 d1\nq1 1 d9\n", encoding="utf-8")
    return str(root)


def read_lines_of(path):
    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]


def test_samples_round_trip(spark, tmp_path, lines):
    good, bad = readers.parse_samples(
        lines(
            json.dumps(SAMPLE), "", json.dumps({**SAMPLE, "gold_relevance": "2"}), json.dumps({**SAMPLE, "gold_relevance": 1.0}),
            json.dumps({**SAMPLE, "docid": 5}), json.dumps({**SAMPLE, "gold_relevance": 1.5}), json.dumps({**SAMPLE, "dataset": "x"}),
            "{", json.dumps({k: v for k, v in SAMPLE.items() if k != "doc"}), json.dumps({**SAMPLE, "more": [1]}),
        )
    )
    assert {r["line_no"]: r["gold_relevance"] for r in good.collect()} == {1: 1, 3: 2, 4: 1, 10: 1}
    assert {r["line_no"]: r["reason"] for r in bad.collect()} == {
        5: "Invalid sample", 6: "Invalid sample", 7: "Invalid sample", 8: "Invalid JSON", 9: "Invalid sample",
    }
    path = str(tmp_path / "samples.ndjson")
    sinks.write_samples(good, path)
    written = read_lines_of(path)
    assert json.loads(written[0]) == SAMPLE and list(json.loads(written[0])) == list(SAMPLE)
    again, _ = readers.read_samples(spark, path)
    assert [r["gold_relevance"] for r in again.orderBy("line_no").collect()] == [1, 2, 1, 1]


def test_judgements_keep_nulls(spark, tmp_path):
    df = spark.sql("SELECT 'm' AS model_id, 'q' AS query_id, 'd' AS docid, CAST(NULL AS INT) AS label, CAST(array() AS array<string>) AS warnings")
    sinks.write_judgements(df, str(tmp_path / "j.ndjson"))
    assert read_lines_of(tmp_path / "j.ndjson") == ['{"model_id":"m","query_id":"q","docid":"d","label":null,"warnings":[]}']
    df.write.parquet(str(tmp_path / "p.parquet"))
    both = readers.read_judgements(spark, [str(tmp_path / "j.ndjson"), str(tmp_path / "p.parquet")])
    assert both.count() == 2 and "raw_text" in both.columns


def test_ordered_sink(spark, tmp_path):
    sinks.write_ndjson(spark.range(500).repartition(7), str(tmp_path / "o"), order_by="id")
    assert [json.loads(x)["id"] for x in read_lines_of(tmp_path / "o")] == list(range(500))
    sinks.write_head(spark.range(500).repartition(7), str(tmp_path / "h"), 3, "id")
    assert read_lines_of(tmp_path / "h") == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_manifests(spark, tmp_path):
    base = str(tmp_path)
    assert telemetry.list_runs(readers.read_manifests(spark, base)).count() == 0
    meta = spark.sql("SELECT 3 AS sample_count, 'mine' AS git_sha")
    for stage, run in (("ingest", "20250101_000000_a"), ("infer", "20250102_000000_b"), ("infer", "20250101_000000_a")):
        sinks.append_manifest(spark, base, run, stage, {"limit": None, "x": 1}, meta, GIT)
    one = readers.read_manifests(spark, base, "ingest", "20250101_000000_a").first()
    assert one["git_sha"] == "mine" and one["git_clean"] is True and one["cli_args"] == {"limit": None, "x": "1"}
    found = readers.read_manifests(spark, base).select("run_id", F.expr("variant_get(manifest, '$.sample_count', 'int')").alias("n"))
    assert {r["n"] for r in found.collect()} == {3}
    assert [r[0] for r in telemetry.list_runs(readers.read_manifests(spark, base)).collect()] == [
        "20250102_000000_b", "20250101_000000_a", "20250101_000000_a",
    ]
    assert telemetry.list_runs(readers.read_manifests(spark, base), "ingest").count() == 1
    with pytest.raises(FileNotFoundError, match="Manifest not found"):
        readers.read_manifests(spark, base, "ingest", "nope")
    # A manifest written over several lines by another program.
    other = tmp_path / "runs" / "ingest" / "x"
    other.mkdir()
    (other / "manifest.json").write_text(json.dumps({"run_id": "x", "cli_name": "ingest", "timestamp": "2025-01-01T00:00:00.5", "cli_args": {}}, indent=2))
    assert readers.read_manifests(spark, base, "ingest", "x").first()["timestamp"].microsecond == 500000


def test_logs_and_splits(spark, tmp_path):
    record = {"event": "asked", "cli": "infer", "run_id": "r", "git_sha": "0badcafe", "model": "m1", "num_samples": 7, "level": "info",
              "logger": "infer", "timestamp": "2031-02-03T04:05:06.070809Z", "extra": [1]}
    (tmp_path / "logs.jsonl").write_text(json.dumps(record) + "\n\n")
    row = readers.read_logs(spark, str(tmp_path / "*.jsonl")).select("*", F.expr("variant_get(fields, '$.extra[0]', 'int')").alias("x")).first()
    assert (row["event"], row["num_samples"], row["x"]) == ("asked", 7, 1)
    assert str(row["timestamp"]) == "2031-02-03 04:05:06.070809"
    (tmp_path / "train.jsonl").write_text('{"sample_id":"a","query":"x"}\n')
    (tmp_path / "test.jsonl").write_text('{"sample_id":"b","query":"y"}\n{"sample_id":"c","query":"z"}\n')
    splits = readers.read_dataset_splits(spark, {s: str(tmp_path / f"{s}.jsonl") for s in ("train", "test")}, "ch", "0.1")
    assert sorted((r["sample_id"], r["split"], r["version"]) for r in splits.collect()) == [("a", "train", "0.1"), ("b", "test", "0.1"), ("c", "test", "0.1")]


def counting():
    def factory():  # local, so that it is sent to the workers by value
        def complete(request):
            return {"raw_text": '{"O": %d}' % (len(request["messages"][0]["content"]) % 3), "cost_estimate": 0.5}

        return complete

    return factory


def refusing():
    def factory():
        def complete(request):
            raise RuntimeError("asked again")

        return complete

    return factory


def test_four_stages(spark, tmp_path, dataset):
    base = str(tmp_path / "artifacts")
    ingested = plans.ingest(spark, dataset, base, "run1", git=GIT)
    assert [(r["query_id"], r["docid"], r["gold_relevance"]) for r in ingested.table.orderBy("line_no").collect()] == [("q2", "d2", 2), ("q1", "d1", 1), ("q1", "d2", 0)]
    manifest = readers.read_manifests(spark, base, "ingest", "run1").select(
        *[F.expr(f"variant_get(manifest, '$.{k}', 'int')").alias(k) for k in ("sample_count", "missing_query", "missing_doc")]
    )
    assert tuple(manifest.first()) == (3, 1, 1)
    assert json.loads(read_lines_of(f"{base}/runs/ingest/run1/samples.head.jsonl")[0])["query_id"] == "q2"

    written = [json.loads(x) for x in read_lines_of(f"{base}/runs/ingest/run1/samples.ndjson")]
    assert [(r["query_id"], r["docid"]) for r in written] == [("q2", "d2"), ("q1", "d1"), ("q1", "d2")]

    models = registry.MODELS[:3]
    inferred = plans.infer(spark, ingested.table, base, "run1", models, completer_factory=counting())
    assert inferred.table.count() == 9 and inferred.table.where("label IS NULL").count() == 0
    written = [json.loads(x) for x in read_lines_of(f"{base}/runs/infer/run1/judgements.ndjson")]
    pairs = [("q2", "d2"), ("q1", "d1"), ("q1", "d2")]
    assert [(r["query_id"], r["docid"], r["model_id"]) for r in written] == [(*p, m) for p in pairs for m in sorted(m.model_id for m in models)]
    again = plans.infer(spark, ingested.table, base, "run2", models, completer_factory=refusing(), judged=inferred.table)
    assert again.table.count() == 9 and again.table.where("cache_hit").count() == 9

    both = readers.read_judgements(spark, [inferred.path, again.path])
    decided = plans.aggregate(spark, both, base, "run1", samples=ingested.table)
    assert decided.table.count() == 3 and {r["disagreement_metrics"]["n_votes"] for r in decided.table.collect()} == {3}
    assert readers.peek(spark, f"{base}/runs/aggregate/*/ensemble.parquet").count() == 3

    scored = plans.evaluate(spark, decided.table, ingested.table, base, "run1", judgements=both)
    row = scored.table.first()
    assert 0 <= row["accuracy"] <= 1 and row["macro_f1"] is not None and sum(c["n"] for c in row["confusion_matrix"]) == 3
    assert spark.read.parquet(f"{base}/runs/evaluate/run1/model_metrics.parquet").count() == 3
    assert telemetry.list_runs(readers.read_manifests(spark, base)).count() == 5


def test_stage_errors(spark, tmp_path, dataset):
    base = str(tmp_path / "artifacts")
    with pytest.raises(ValueError, match="Unsupported dataset"):
        plans.ingest(spark, dataset, base, "r", dataset="unknown")
    limited = plans.ingest(spark, dataset, base, "r", limit=2)
    assert limited.table.count() == 2
    with pytest.raises(ValueError, match="either"):
        plans.infer(spark, limited.table, base, "r")
    with pytest.raises(Exception, match="asked again"):
        plans.infer(spark, limited.table, base, "r2", registry.MODELS[:1], completer_factory=refusing())
    with pytest.raises(KeyError, match="Unknown strategy"):
        plans.aggregate(spark, limited.table, base, "r", strategy="none")
    Path(dataset, "llm4eval_test_qrel_2024.txt").write_text("q1 1 d1\nq1 1\n")
    with pytest.raises(ValueError, match="Invalid qrel line at line 2"):
        plans.ingest(spark, dataset, base, "bad")
    assert plans.ingest(spark, dataset, base, "lenient", strict=False).table.count() == 1
    counts = readers.read_manifests(spark, base, "ingest", "lenient").select(
        *[F.expr(f"variant_get(manifest, '$.rejected_{t}', 'int')") for t in ("queries", "documents", "qrels")])
    assert tuple(counts.first()) == (0, 0, 1)


def test_samples_carry_their_adapter_s_dataset(spark, tmp_path, dataset):
    from jurybox.sources import parsers

    parsers.register_adapter("own-set", parsers.read_judge_dataset, "own-set-7")
    try:
        made = plans.ingest(spark, dataset, str(tmp_path), "r", dataset="Own-Set ")
        assert {r["dataset"] for r in made.table.collect()} == {"own-set-7"}
        again, bad = readers.read_samples(spark, f"{tmp_path}/runs/ingest/r/samples.ndjson")
        assert again.count() == 3 and bad.count() == 0
    finally:
        del parsers.ADAPTERS["own-set"], parsers.DATASETS["own-set"]


def test_rejects_are_counted_in_one_scan(spark, tmp_path):
    from jurybox.sources.parsers import Rejects, mark_qrels
    from jurybox.sources.lines import read_lines

    (tmp_path / "q.txt").write_text("q 1 d\nq x d\n\nq 1\nq 2 e\n")
    rejects, counted = Rejects.of(mark_qrels(read_lines(spark, str(tmp_path / "q.txt")).repartition(3)))
    counted.write.parquet(str(tmp_path / "marked"))
    assert rejects.check(strict=False) == rejects.count == 2 and spark.read.parquet(str(tmp_path / "marked")).count() == 4
    with pytest.raises(ValueError, match="Invalid relevance at line 2: 'q x d'"):
        rejects.check()
    fine, counted = Rejects.of(mark_qrels(read_lines(spark, str(tmp_path / "q.txt")).limit(1)))
    counted.write.parquet(str(tmp_path / "fine"))
    assert fine.check() == 0


def test_runs_without_manifest_show(spark, tmp_path):
    base = str(tmp_path)
    assert readers.read_runs(spark, base).count() == 0
    for stage, run in (("ingest", "20250101_000000_a"), ("infer", "20250103_000000_c"), ("infer", "crashed")):
        (tmp_path / "runs" / stage / run).mkdir(parents=True)
    assert {(r["run_id"], r["finished"]) for r in readers.read_runs(spark, base, "infer").collect()} == {("20250103_000000_c", False), ("crashed", False)}
    sinks.append_manifest(spark, base, "20250102_000000_b", "infer", {}, None, GIT)
    (tmp_path / "runs" / "infer" / "20250103_000000_c" / "manifest.json").write_text(json.dumps({"run_id": "another", "cli_name": "odd"}))
    runs = readers.read_runs(spark, base)
    assert {(r["cli_name"], r["run_id"]): r["finished"] for r in runs.collect()} == {
        ("ingest", "20250101_000000_a"): False, ("infer", "20250102_000000_b"): True, ("infer", "20250103_000000_c"): True, ("infer", "crashed"): False}
    assert [r[0] for r in telemetry.list_runs(runs, "infer").collect()] == ["crashed", "20250103_000000_c", "20250102_000000_b"]


def test_stream_judges_each_file_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(name, docid):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps({**SAMPLE, "docid": docid}) + "\n")

    def run(factory):
        query = judge_new_samples(spark, source, out, factory, registry.MODELS[:2], checkpoint=checkpoint)
        query.awaitTermination()
        return sorted((r["docid"], r["model_id"]) for r in spark.read.parquet(out).collect())

    arrive("a.json", "d1")
    assert run(counting()) == [("d1", "gpt-oss-20b"), ("d1", "qwen-0.5b")]
    assert len(run(refusing())) == 2  # nothing new, nobody asked
    arrive("b.json", "d2")
    assert len(run(counting())) == 4
