"""What the physical plans must and must not contain."""

import pytest

from jurybox.sources import sinks
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(query(spark, SF)) for name, query in QUERIES.items() if name != "fit_calibration"}


def test_python_only_where_a_model_is_asked(plans):
    for name, plan in plans.items():
        assert ("MapInPandas" in plan) == (name == "judge"), name
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_what_is_used(plans):
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plans["parse_qrels"]
    for name in ("render_prompt", "build_samples"):
        assert "n_chars" not in plans[name] and "source" not in plans[name].split("Batched")[1]


def test_json_is_parsed_once(plans):
    assert plans["parse_documents"].count("from_json") <= 2  # as read, and stripped where that fails
    for line in plans["describe_latency"].splitlines():
        assert not ("Filter" in line and "from_json" in line)


def test_small_tables_are_broadcast(plans):
    assert plans["build_samples"].count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plans["build_samples"]


def test_large_tables_are_spread(plans):
    assert "_salt" in plans["build_samples_spread"] and "_salt" not in plans["build_samples"]


# Each makes samples with their text; limit_examples and the like need only the keys.
WITH_TEXT = (
    "build_samples", "build_samples_spread", "limit_samples", "parse_samples", "to_canonical_sample", "token_budget", "render_prompt",
    "render_prompt_aspects", "render_relevance_v1", "build_requests", "judge", "cache_split", "cache_split_unanswered",
)


@pytest.fixture
def threshold(spark):
    """Broadcasts up to 64 kB: the smallest documents, 290 kB as a file, are above, all other tables below."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    yield
    spark.conf.set(key, before)


def broadcasts(plan):
    """The columns of every broadcast in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind in ("AdaptiveSparkPlanExec", "ResultQueryStageExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
        return broadcasts(plan.executedPlan() if kind.startswith("Adaptive") else plan.plan())
    below = plan.children()
    found = [plan.output().mkString(",")] if kind == "BroadcastExchangeExec" else []
    return found + [x for i in range(below.size()) for x in broadcasts(below.apply(i))]


@pytest.mark.parametrize("name", WITH_TEXT)
def test_documents_above_the_threshold_are_spread(spark, threshold, name):
    assert "_salt" in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["build_samples", "build_samples_spread"])
def test_texts_above_the_threshold_are_not_broadcast(spark, threshold, name):
    df = QUERIES[name](spark, SF)
    assert df.collect()
    sent = broadcasts(df._jdf.queryExecution().executedPlan())
    assert sent and not any("doc#" in columns for columns in sent)


# Each is run as a whole: what is broadcast is settled only while it runs.
SENDS_NO_TEXT = (
    "build_requests",
    "cache_split",
    "cache_split_unanswered",
    "judge",
    "limit_samples",
    "render_prompt",
    "render_prompt_aspects",
    "render_relevance_v1",
    "to_canonical_sample",
    "parse_samples",
    "token_budget",
)


@pytest.mark.parametrize("name", SENDS_NO_TEXT)
def test_no_text_is_sent_to_the_driver(spark, threshold, name):
    df = QUERIES[name](spark, SF)
    assert df.collect()
    sent = broadcasts(df._jdf.queryExecution().executedPlan())
    assert sent and not any("doc#" in columns for columns in sent)


def test_written_samples_send_no_text_to_the_driver(spark, threshold, monkeypatch):
    written, write = [], sinks.write_samples
    monkeypatch.setattr(sinks, "write_samples", lambda df, path: (written.append(df), write(df, path)))
    assert QUERIES["write_samples"](spark, SF).collect() and written[0].collect()
    sent = broadcasts(written[0]._jdf.queryExecution().executedPlan())
    assert sent and not any("doc#" in columns for columns in sent)


def test_votes_are_combined_before_the_shuffle(plans):
    assert "partial_max" in plans["weighted_vote"] and "partial_sum" in plans["weighted_vote"]
