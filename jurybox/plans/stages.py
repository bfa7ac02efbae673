"""ingest, infer, aggregate and evaluate over a run directory.

A stage writes its table first and derives summaries from what is on disk, so
nothing expensive (model calls above all) is computed twice, and a lost
executor repeats only its own tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from inspect import Parameter, signature
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.functions.prompts import prompt, render_prompt
from jurybox.operators import requests as rq
from jurybox.operators import samples as sm
from jurybox.operators import scores as sc
from jurybox.operators import telemetry as tm
from jurybox.operators.votes import STRATEGIES
from jurybox.sources.parsers import ADAPTERS, DATASETS, Rejects, resolve_dataset, split_marked
from jurybox.sources.registry import MODELS, WEIGHTS, ModelSpec, models_df
from jurybox.sources.sinks import (
    SliceLog, append_manifest, run_path, write_head, write_judgements, write_metrics, write_run_parquet, write_samples,
)

HEAD_ROWS = 20


@dataclass(frozen=True)
class RunResult:
    run_id: str
    path: str
    manifest: str
    table: DataFrame


def ingest(
    spark: SparkSession, data_dir: str, base: str, run_id: str, dataset: str = "llm-judge",
    limit: int | None = None, strict: bool = True, git: Mapping[str, Any] | None = None, ndjson: bool = True,
) -> RunResult:
    """Read and join the raw files; `samples.parquet`, `samples.ndjson` in the order of the qrels, a preview and the manifest.

    Rejected lines are counted while the parsed tables are written; the manifest says how many there were
    of each. With `strict` the first one, by number, is an error.
    """
    key = dataset.lower().strip()
    if key not in ADAPTERS:
        resolve_dataset(key)  # raises
    # The raw text is parsed once; what follows reads columns of the written tables.
    parsed, rejected = {}, {}
    for name, marked in ADAPTERS[key](spark, data_dir).items():
        rejects, counted = Rejects.of(marked)
        path = write_run_parquet(counted, base, "ingest", run_id, f"parsed/{name}")
        rejected[name] = rejects.check(strict)
        parsed[name] = split_marked(spark.read.parquet(path), name)[0]
    qrels, queries, documents = (parsed[t] for t in ("qrels", "queries", "documents"))
    samples = sm.build_samples(qrels, queries, documents, dataset=DATASETS[key])
    if limit is not None:
        samples = sm.limit_samples(samples, limit)
    path = write_run_parquet(samples, base, "ingest", run_id, "samples")
    written = spark.read.parquet(path)
    if ndjson:
        write_samples(written, f"{run_path(base, 'ingest', run_id)}/samples.ndjson")
    write_head(written, f"{run_path(base, 'ingest', run_id)}/samples.head.jsonl", HEAD_ROWS, "line_no")
    summary = sm.ingest_summary(written).withColumns({f"rejected_{name}": F.lit(n) for name, n in rejected.items()})
    if limit is None:  # the skip counts are known only when all qrels were read
        missing = sm.missing_counts(qrels, queries, documents).first()
        summary = summary.withColumns({k: F.lit(v) for k, v in missing.asDict().items()})
    manifest = append_manifest(
        spark, base, run_id, "ingest", {"dataset": key, "data_dir": data_dir, "limit": limit},
        summary.withColumn("output_file", F.lit(path)), git,
    )
    return RunResult(run_id, path, manifest, written)


def infer(
    spark: SparkSession, samples: DataFrame, base: str, run_id: str, models: Sequence[ModelSpec] = MODELS,
    prompt_name: str = "thomas-et-al-prompt", variables: Mapping[str, Any] | None = None,
    completer_factory: Callable[[], rq.Completer] | None = None, completions: DataFrame | None = None,
    judged: DataFrame | str | None = None, limit: int | None = None, partitions: int | None = None, concurrent: int = 1,
    git: Mapping[str, Any] | None = None, slices: int = 1, per_second: float | None = None,
    ndjson: bool = True,
) -> RunResult:
    """Judge samples with a panel; `judgements.parquet` by model, `judgements.ndjson` in sample order and the manifest.

    Answers come from `completer_factory` or the table `completions`; prompts found in `judged`, an
    earlier judgements table or the name of a table of `write_cache`, are not asked again. Raw answers
    are written slice by slice under `answers/`, each with a commit record. A run that failed is called
    again with the same run_id and arguments: it asks nothing of the slices that have a record.
    """
    if (completer_factory is None) == (completions is None):
        raise ValueError("give either completer_factory or completions")
    if limit is not None:
        samples = sm.limit_examples(samples, limit)
    registry = rq.check_models(models_df(spark, models))
    prompts = rq.hash_prompts(render_prompt(samples, prompt_name, **(variables or {})))
    answered = []
    if judged is None:
        asked = rq.fan_out(prompts, models)
    else:
        if isinstance(judged, str):
            marked, judged = rq.split_stored(prompts, judged, models), spark.table(judged)
        else:
            marked = rq.split_panel(prompts, judged, models)
        asked = marked.withColumn("model_id", F.explode("to_ask")).drop("cached", "to_ask")
        order = [c for c in ("line_no",) if c in prompts.columns]
        hits = marked.select(*order, "query_id", "docid", "prompt_sha256", F.explode("cached").alias("model_id"))
        hits = rq.attach_model(hits, registry)[0].drop("context_window", "temperature", "max_tokens")
        answered.append(rq.answer_from_cache(hits.withColumn("cache_hit", F.lit(True)), judged))
    requests = rq.build_requests(rq.attach_model(asked, registry)[0])
    if judged is not None:
        requests = requests.withColumn("cache_hit", F.lit(False))
    if completions is not None:
        answered.append(rq.judge_offline(requests, completions))
    else:
        log = SliceLog(spark, f"{run_path(base, 'infer', run_id)}/answers", slices, {
            "prompt": prompt_name, "variables": str(sorted((variables or {}).items())), "limit": limit,
            "models": json.dumps([asdict(m) for m in models], sort_keys=True)})
        answered += rq.judge_slices(
            requests, completer_factory, log.write, slices, partitions, concurrent, per_second, log.finished())
    raw = answered[0]
    for more in answered[1:]:
        raw = raw.unionByName(more, allowMissingColumns=True)

    spec = prompt(prompt_name)
    rows = rq.to_judgement(raw, spec.response_parser or "parse_label").withColumn("run_id", F.lit(run_id))
    path = write_run_parquet(rows, base, "infer", run_id, "judgements", ["model_id"])
    written = spark.read.parquet(path)
    good, rejected = rq.validate_judgements(written)
    if ndjson:
        write_judgements(good, f"{run_path(base, 'infer', run_id)}/judgements.ndjson")
    summary = rq.infer_summary(good).withColumns({
        "rejected_count": rejected.agg(F.count(F.lit(1))).scalar(),
        "prompt_template": F.lit(prompt_name),
        "models": F.array(*[F.lit(m.model_id) for m in models]),
        "model_config": F.lit(json.dumps([asdict(m) for m in models], sort_keys=True)),
        "output_file": F.lit(path),
    })
    manifest = append_manifest(
        spark, base, run_id, "infer",
        {"models": ",".join(m.model_id for m in models), "limit": limit, "prompt": prompt_name}, summary, git,
    )
    return RunResult(run_id, path, manifest, good)


def _taken(strategy: Callable[..., DataFrame], **offered: Any) -> dict[str, Any]:
    """What a registered strategy takes of what the stage has to offer; weights only if it names them."""
    known = signature(strategy).parameters
    open_ended = any(p.kind == Parameter.VAR_KEYWORD for p in known.values())
    return {k: v for k, v in offered.items() if k in known or open_ended and k != "weights"}


def aggregate(
    spark: SparkSession, judgements: DataFrame, base: str, run_id: str, strategy: str = "weighted_majority",
    weights: Mapping[str, float] | DataFrame | None = WEIGHTS, samples: DataFrame | None = None,
    git: Mapping[str, Any] | None = None, **options: Any,
) -> RunResult:
    """Combine the panel's judgements; `ensemble.parquet` and the manifest."""
    if strategy not in STRATEGIES:
        raise KeyError(f"Unknown strategy: {strategy}. Known: {', '.join(sorted(STRATEGIES))}")
    ensemble = STRATEGIES[strategy](judgements, **_taken(STRATEGIES[strategy], weights=weights, samples=samples), **options)
    path = write_run_parquet(ensemble, base, "aggregate", run_id, "ensemble")
    written = spark.read.parquet(path)
    summary = written.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("final_label").isNull()).alias("undecided_count"),
        F.count_if(F.array_contains("flags", "tie")).alias("tie_count"),
    ).withColumn("output_file", F.lit(path))
    manifest = append_manifest(spark, base, run_id, "aggregate", {"strategy": strategy}, summary, git)
    return RunResult(run_id, path, manifest, written)


def evaluate(
    spark: SparkSession, ensemble: DataFrame, samples: DataFrame, base: str, run_id: str,
    judgements: DataFrame | None = None, git: Mapping[str, Any] | None = None,
) -> RunResult:
    """Score the ensemble; `metrics.json`, slices, bins and the manifest."""
    root = run_path(base, "evaluate", run_id)
    scored = sc.join_gold(
        ensemble.select("query_id", "docid", "final_label", "final_confidence"), samples
    )
    write_run_parquet(scored, base, "evaluate", run_id, "scored")
    scored = spark.read.parquet(f"{root}/scored.parquet")
    write_metrics(sc.metrics_table(scored), f"{root}/metrics.json")
    write_run_parquet(sc.error_slices(scored, ["gold", "query_id"]), base, "evaluate", run_id, "slices")
    write_run_parquet(sc.calibration_bins(scored), base, "evaluate", run_id, "calibration")
    if judgements is not None:
        by_model = sc.classification_metrics(sc.judgement_scores(judgements, samples), ["model_id"])
        write_run_parquet(by_model, base, "evaluate", run_id, "model_metrics")
        write_run_parquet(tm.cost_latency(judgements), base, "evaluate", run_id, "cost_latency")
    summary = sc.classification_metrics(scored).withColumn("output_file", F.lit(f"{root}/metrics.json"))
    checksum = tm.dataset_checksum(samples).select(F.col("checksum").cast("string").alias("dataset_checksum")).first()
    summary = summary.withColumn("dataset_checksum", F.lit(checksum["dataset_checksum"]))
    manifest = append_manifest(spark, base, run_id, "evaluate", {}, summary, git)
    return RunResult(run_id, f"{root}/metrics.json", manifest, spark.read.json(f"{root}/metrics.json"))
