"""Fan-out, model settings, requests, cache, judging, validation."""

import time
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jurybox import plans
from jurybox.functions import prompts
from jurybox.operators import requests as rq
from jurybox.sources import cache, registry, sinks


@pytest.fixture
def asked(spark):
    rows = [(1, "q1", "What is AI?", "d1", "AI is..."), (2, "q2", "Define ML", "d2", "ML"), (3, "q1", "What is AI?", "d2", "ML")]
    samples = spark.createDataFrame(rows, "line_no bigint, query_id string, query_text string, docid string, doc string")
    models = registry.models_df(spark)
    ready, rejects = rq.attach_model(rq.fan_out(samples, registry.MODELS), models)
    assert rejects.count() == 0
    return rq.build_requests(prompts.render_prompt(ready))


def test_registry(spark):
    assert registry.model("phi3-mini").provider == "hf"
    with pytest.raises(KeyError, match="Model config not found"):
        registry.model("unknown")
    row = registry.models_df(spark).where("model_id = 'gpt-oss-20b'").first()
    assert row["context_window"] == 8192 and row["default_params"] == {"temperature": "0.0", "max_tokens": "256"}
    assert row["openrouter_model_id"] == "openai/gpt-oss-20b:free"
    with pytest.raises(ValueError, match="unique"):
        registry.check_panel(registry.MODELS * 2)


def test_requests(asked):
    assert asked.count() == 12
    row = asked.where("model_id = 'qwen-0.5b' AND line_no = 2").first()
    request = row["request"].asDict(recursive=True)
    assert request["model"] == "qwen/qwen-0.5b-chat" and request["timeout"] == 30
    assert request["temperature"] == 0.0 and request["max_tokens"] == 256
    assert [m["role"] for m in request["messages"]] == ["user"] and "[Define ML]" in request["messages"][0]["content"]


def test_defaults_and_rejects(spark):
    specs = [
        registry.ModelSpec("bare", "openrouter", 1, openrouter_model_id="x/y"),
        registry.ModelSpec("no-id", "openrouter", 1),
        registry.ModelSpec("other", "elsewhere", 1),
    ]
    models = registry.models_df(spark, specs)
    rows = spark.createDataFrame([("bare",), ("no-id",), ("other",), ("ghost",)], "model_id string")
    good, bad = rq.attach_model(rows, models)
    assert [(r["model_id"], r["temperature"], r["max_tokens"]) for r in good.collect()] == [("bare", 0.0, 256)]
    assert dict(bad.select("model_id", "reason").collect()) == {
        "no-id": "Missing openrouter_model_id: no-id",
        "other": "Unsupported provider: elsewhere",
        "ghost": "Model config not found: ghost",
    }
    with pytest.raises(ValueError, match="Missing openrouter_model_id"):
        rq.check_models(models)


def test_judge_one_completer_per_partition(asked):
    def factory():
        calls = []

        def complete(request):
            calls.append(request["model"])
            return {"raw_text": '{"O": %d}' % (len(calls) > 0), "version": "v%d" % len(calls)}

        return complete

    judged = rq.to_judgement(rq.judge(asked, factory, partitions=1)).orderBy("line_no", "model_id").collect()
    assert len(judged) == 12 and {r["label"] for r in judged} == {1}
    assert sorted(int(r["version"][1:]) for r in judged) == list(range(1, 13))
    assert all(r["latency_ms"] >= 0 and r["retries"] == 0 and r["warnings"] == [] for r in judged)


def test_providers_by_name(asked):
    def answering(label):
        def factory():
            return lambda request: {"raw_text": '{"O": %d}' % label}

        return factory

    given = {"openrouter": answering(1), "hf": answering(2)}
    some = asked.where("model_id <> 'tinyllama'")
    got = rq.to_judgement(rq.judge(some, rq.by_provider(given), partitions=2)).select("provider", "label").distinct()
    assert sorted(tuple(r) for r in got.collect()) == [("hf", 2), ("openrouter", 1)]
    with pytest.raises(Exception, match="No completer given for provider ollama"):
        rq.judge(asked, rq.by_provider(given), partitions=2).collect()


def test_failing_completer_fails_the_job(asked):
    def factory():
        def complete(request):
            raise TimeoutError("model did not answer")

        return complete

    with pytest.raises(Exception, match="model did not answer"):
        rq.judge(asked, factory).collect()


@pytest.mark.parametrize("salted", [None, True])
def test_cache(asked, salted):
    stored = asked.where("line_no <= 2 AND model_id <> 'tinyllama'").select(
        "model_id", "prompt_sha256", F.lit('{"O": 2}').alias("raw_text"), F.lit("v").alias("version"),
        F.lit(5.0).alias("latency_ms"), F.lit(1).alias("retries"), F.lit(0.25).alias("cost_estimate"), F.lit("r2").alias("run_id"),
    )
    older = stored.withColumns({"run_id": F.lit("r1"), "raw_text": F.lit('{"O": 0}')})
    judged = stored.unionByName(older)
    hits, misses = rq.cache_split(asked, judged, salted)
    assert hits.count() == 6 and misses.count() == 6
    assert misses.where("line_no = 3").count() == 4
    answered = rq.to_judgement(rq.answer_from_cache(hits, judged, salted)).collect()
    assert {(r["label"], r["cache_hit"], r["cost_estimate"]) for r in answered} == {(2, True, 0.25)}
    assert len(answered) == 6


@pytest.mark.parametrize("salted", [None, True])
def test_offline_answers(spark, asked, salted):
    answers = spark.createDataFrame(
        [("q1", "d1", "phi3-mini", '{"O": 2}', 10.0), ("q2", "d2", "tinyllama", "none", 20.0)],
        "query_id string, docid string, model_id string, raw_text string, latency_ms double",
    )
    rows = rq.to_judgement(rq.judge_offline(asked, answers, salted))
    assert rows.count() == 12
    good, bad = rq.validate_judgements(rows)
    got = {r["model_id"]: (r["label"], r["version"], len(r["warnings"])) for r in good.collect()}
    assert got == {"phi3-mini": (2, "microsoft/Phi-3-mini-4k-instruct", 0), "tinyllama": (None, "tinyllama", 1)}
    assert bad.count() == 10 and bad.where("reason LIKE 'Missing required: raw_text%'").count() == 10


def test_summary_of_no_rows(asked):
    none = rq.to_judgement(rq.judge_offline(asked, asked.limit(0).select("query_id", "docid", "model_id", F.lit("").alias("raw_text"), F.lit(0.0).alias("latency_ms")))).limit(0)
    assert tuple(rq.infer_summary(none).first()) == (0, 0, 0.0)


def test_validation_ranges(spark):
    rows = [("ok", 1, 1.0, 0.5), ("label", 3, 1.0, 0.5), ("score", 1, 2.5, 0.5), ("conf", 1, 1.0, -0.1), ("nulls", None, None, None)]
    df = spark.createDataFrame(rows, "model_id string, label int, score double, confidence double").select(
        "*", F.lit("hf").alias("provider"), F.lit("q").alias("query_id"), F.lit("d").alias("docid"), F.lit("t").alias("raw_text"),
        F.lit(1.0).alias("latency_ms"), F.lit(0).alias("retries"), F.array().cast("array<string>").alias("warnings"),
    )
    good, bad = rq.validate_judgements(df)
    assert {r["model_id"] for r in good.collect()} == {"ok", "nulls"}
    assert dict(bad.select("model_id", "reason").collect()) == {
        "label": "Invalid label", "score": "Invalid score", "conf": "Invalid confidence",
    }


@pytest.mark.parametrize("salted", [None, True])
def test_unanswered_rows_are_no_hits(asked, salted):
    stored = asked.select("model_id", "prompt_sha256", F.when(F.col("model_id") == "tinyllama", '{"O": 1}').alias("raw_text"),
                          F.lit("v").alias("version"), F.lit(1.0).alias("latency_ms"), F.lit(0).alias("retries"),
                          F.lit(0.1).alias("cost_estimate"), F.lit("r1").alias("run_id"))
    hits, misses = rq.cache_split(asked, stored, salted)
    assert {r["model_id"] for r in hits.collect()} == {"tinyllama"} and misses.where("model_id = 'tinyllama'").count() == 0
    later = stored.withColumns({"raw_text": F.lit(None).cast("string"), "run_id": F.lit("r2")})
    again = rq.answer_from_cache(hits, stored.unionByName(later), salted).collect()
    assert len(again) == hits.count() and {r["raw_text"] for r in again} == {'{"O": 1}'}


def test_panel_split_moves_text_once(spark):
    rows = [(i, f"q{i % 3}", f"d{i}", f"prompt {i % 4} " * 20) for i in range(12)]
    prompts = rq.hash_prompts(spark.createDataFrame(rows, "line_no bigint, query_id string, docid string, prompt string"))
    models = list(registry.MODELS)[:3]
    judged = prompts.where("line_no < 2").select("prompt_sha256", F.lit(models[0].model_id).alias("model_id"), F.lit("x").alias("raw_text"))
    split = rq.split_panel(prompts, judged, models, salted=True).orderBy("line_no").collect()
    for r in split:
        known = [models[0].model_id] if r["line_no"] % 4 < 2 else []
        assert r["cached"] == known and r["to_ask"] == [m.model_id for m in models if m.model_id not in known]
    asked = rq.split_panel(prompts, judged, models, salted=True).select("line_no", "prompt", F.explode("to_ask").alias("model_id"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.splitlines()[0] or "Generate" in plan.splitlines()[1]  # models come after the join


def test_slices_before_a_failure_are_kept(asked, tmp_path, spark):
    total = asked.count()
    written = []

    def factory():
        def complete(request):
            if len(written) and "q3" in request["messages"][0]["content"]:
                raise TimeoutError("late")
            return {"raw_text": '{"O": 1}', "latency_ms": 1.0}

        return complete

    def write(df, k):
        path = f"{tmp_path}/slice{len(written)}"
        df.write.parquet(path)
        written.append(path)
        return spark.read.parquet(path)

    parts = rq.judge_slices(asked, factory, write, slices=2, concurrent=3)
    assert sum(p.count() for p in parts) == total and len(written) == 2

    def failing():
        def complete(request):
            raise TimeoutError("late")

        return complete

    with pytest.raises(Exception, match="late"):
        rq.judge_slices(asked, failing, write, slices=2)
    stored = spark.read.parquet(written[0])
    assert rq.cache_split(asked, stored)[1].count() == total - stored.count()


def test_concurrent_calls_keep_order(asked):
    def factory():
        import time

        def complete(request):
            time.sleep(0.01 * (len(request["model"]) % 3))
            return {"raw_text": request["model"], "latency_ms": 1.0}

        return complete

    rows = rq.judge(asked, factory, partitions=1, concurrent=4).collect()
    assert len(rows) == asked.count() and all(r["raw_text"] == r["provider_model"] for r in rows)


@pytest.fixture
def stored(spark, asked):
    """A bucketed table that answers the prompts of the first and last sample for two models."""
    judged = asked.where("line_no <> 2 AND model_id IN ('phi3-mini', 'qwen-0.5b')").select(
        "model_id", "prompt_sha256", "query_id", "docid", F.lit('{"O": 1}').alias("raw_text"), F.lit("r1").alias("run_id"))
    more = judged.limit(1).withColumn("raw_text", F.lit(None).cast("string")).withColumn("model_id", F.lit("tinyllama"))
    cache.write_cache(judged.union(more), "answers", buckets=4)
    yield "answers"
    for table in ("answers", "answers_prompts"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_stored_side_is_not_shuffled(spark, asked, stored):
    prompts_ = asked.select("line_no", "query_id", "docid", "prompt_sha256").distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = rq.split_panel(prompts_, cache.read_cache(spark, stored), registry.MODELS, salted=False)
        plan = met._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("ObjectHashAggregate(keys=[prompt_sha256"):] if "ObjectHashAggregate(keys=[prompt_sha256" in plan else ""
        assert side and "Bucketed: true" in side and "Exchange" not in side
        both = [rq.split_stored(prompts_, stored, registry.MODELS), rq.split_panel(prompts_, spark.table(stored), registry.MODELS)]
        got = [sorted((r["line_no"], tuple(sorted(r["cached"])), tuple(sorted(r["to_ask"]))) for r in df.collect()) for df in both]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got[0] == got[1] and [g[1] for g in got[0]] == [("phi3-mini", "qwen-0.5b"), (), ("phi3-mini", "qwen-0.5b")]


def test_filter_forgets_no_prompt(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("prompt_sha256"), F.lit("m").alias("model_id"), "id")
    cache.write_cache(rows.where("id < 10000"), "many", buckets=4)
    try:
        known = rows.withColumn("known", cache.may_be_stored(spark, "many")).groupBy("known", F.col("id") < 10_000).count().collect()
        counts = {(r[0], r[1]): r["count"] for r in known}
        assert (False, True) not in counts and counts[(True, True)] == 10_000 and counts.get((True, False), 0) < 500
        cache.write_cache(rows.where("id >= 15000"), "many", buckets=4, mode="append")
        assert rows.where("id >= 15000").where(cache.may_be_stored(spark, "many")).count() == 5_000
        odd = spark.createDataFrame([(None,), ("",), ("short",)], "prompt_sha256 string")
        assert odd.where(cache.may_be_stored(spark, "many")).count() <= 3
        cache.write_cache(rows.limit(0), "many", buckets=4)
        assert rows.where(cache.may_be_stored(spark, "many")).count() == 0
    finally:
        for table in ("many", "many_prompts"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_one_rate_for_all_tasks(asked):
    def factory():
        return lambda request: {"raw_text": str(time.time())}

    times = sorted(float(r["raw_text"]) for r in rq.judge(asked, factory, partitions=3, concurrent=4, per_second=20.0).collect())
    assert len(times) == 12 and times[-1] - times[0] >= (12 / 3 - 2) * 3 / 20


def test_infer_goes_on_after_a_failed_slice(spark, tmp_path):
    samples = spark.createDataFrame(
        [(i, "llm-judge-2024", f"q{i}", "text", f"d{i}", f"body{i}x", 1) for i in range(30)],
        "line_no bigint, dataset string, query_id string, query_text string, docid string, doc string, gold_relevance bigint")
    models, base, slices = registry.MODELS[:2], str(tmp_path / "base"), 3
    keyed = rq.fan_out(samples, models)
    parts = {}
    for r in keyed.select("line_no", rq.slice_of(keyed.columns, slices).alias("part")).collect():
        parts.setdefault(r["line_no"], set()).add(r["part"])
    in_second = [i for i, p in parts.items() if 1 in p and 0 not in p]
    in_first = [i for i, p in parts.items() if p == {0}]
    assert in_second and in_first

    def refusing(numbers):
        def factory():
            def complete(request):
                if any(f"body{i}x" in request["messages"][0]["content"] for i in numbers):
                    raise RuntimeError("refused")
                return {"raw_text": '{"O": 2}', "cost_estimate": 1.0}

            return complete

        return factory

    with pytest.raises(Exception, match="refused"):
        plans.infer(spark, samples, base, "r", models, completer_factory=refusing(in_second), slices=slices)
    assert sinks.children(spark, f"{base}/runs/infer/r/answers/commits") == ["0"]
    again = plans.infer(spark, samples, base, "r", models, completer_factory=refusing(in_first), slices=slices)
    assert again.table.count() == 60 and again.table.where("label = 2").count() == 60
    with pytest.raises(ValueError, match="other settings"):
        sinks.SliceLog(spark, f"{base}/runs/infer/r/answers", 4, {}).finished()


def test_judge_lets_go_of_a_batch_before_the_next_is_read(spark, asked, monkeypatch):
    taken = []
    monkeypatch.setattr(type(asked), "mapInPandas", lambda self, ask, schema: taken.append(ask))

    def factory():
        return lambda request: {"raw_text": request["messages"][0]["content"]}

    rq.judge(asked, factory, partitions=0)
    given, alive = [], []

    def batches():
        for k in range(3):
            alive.append(sum(r() is not None for r in given))
            kept = {c: [f"{c}{k}"] for c in asked.columns if c != "request"}
            frame = pd.DataFrame({**kept, "request": [{"messages": [{"content": f"prompt {k}"}]}]})
            given.append(weakref.ref(frame))
            yield frame
            del frame

    answers = [out["raw_text"].tolist() for out in taken[0](batches())]
    assert answers == [["prompt 0"], ["prompt 1"], ["prompt 2"]] and alive == [0, 0, 0]
