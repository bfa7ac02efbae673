"""Infer operators: fan-out over the panel, requests, cache, judging, assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.functions.answers import parser
from jurybox.operators.joins import lookup_join
from jurybox.sources.cache import answered, may_be_stored, read_cache
from jurybox.sources.registry import (
    MAX_TOKENS, PROVIDERS, TEMPERATURE, TIMEOUT_SECONDS, ModelSpec, check_panel,
)

PAIR = ["query_id", "docid"]


def fan_out(samples: DataFrame, models: Sequence[ModelSpec]) -> DataFrame:
    """One row per sample and model, in place: no join, no shuffle."""
    ids = F.array(*[F.lit(m.model_id) for m in check_panel(models)])
    return samples.withColumn("model_id", F.explode(ids))


def attach_model(df: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model settings onto rows by model_id; (good, rejects with reason)."""
    settings = models.select(
        "model_id",
        "provider",
        "context_window",
        F.coalesce(F.element_at("default_params", "temperature").try_cast("double"), F.lit(TEMPERATURE)).alias("temperature"),
        F.coalesce(F.element_at("default_params", "max_tokens").try_cast("int"), F.lit(MAX_TOKENS)).alias("max_tokens"),
        "openrouter_model_id",
        F.coalesce("openrouter_model_id", "hf_model_name", "model_id").alias("provider_model"),
    )
    joined = lookup_join(df, settings, "model_id", "left")
    reason = (
        F.when(F.col("provider").isNull(), F.concat(F.lit("Model config not found: "), F.coalesce("model_id", F.lit("null"))))
        .when(~F.col("provider").isin(*PROVIDERS), F.concat(F.lit("Unsupported provider: "), "provider"))
        .when(
            (F.col("provider") == "openrouter") & (F.coalesce("openrouter_model_id", F.lit("")) == ""),
            F.concat(F.lit("Missing openrouter_model_id: "), "model_id"),
        )
    )
    marked = joined.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).drop("reason", "openrouter_model_id")
    return good, marked.where(F.col("reason").isNotNull()).select(*df.columns, "reason")


def check_models(models: DataFrame) -> DataFrame:
    """Raise if a model of the registry cannot be asked; looks at the registry only."""
    _, bad = attach_model(models.select("model_id"), models)
    first = bad.agg(F.min("reason").alias("reason")).first()["reason"]
    if first is not None:
        raise ValueError(first)
    return models


def build_requests(prompts: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """One user message per row, with the settings `attach_model` put there."""
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    request = F.struct(
        F.col("provider"),
        F.col("provider_model").alias("model"),
        F.array(message).alias("messages"),
        F.col("temperature"),
        F.col("max_tokens"),
        F.lit(timeout).alias("timeout"),
    )
    order = [c for c in ("line_no",) if c in prompts.columns]
    return prompts.select(
        *order,
        *PAIR,
        "model_id",
        "provider",
        "provider_model",
        (F.col("prompt_sha256") if "prompt_sha256" in prompts.columns else F.sha2("prompt", 256)).alias("prompt_sha256"),
        request.alias("request"),
    )


CACHE_KEY = ["model_id", "prompt_sha256"]


def hash_prompts(prompts: DataFrame) -> DataFrame:
    """Add `prompt_sha256`. A prompt does not depend on the model, so hash before `fan_out`."""
    return prompts.withColumn("prompt_sha256", F.sha2("prompt", 256))


def split_panel(
    prompts: DataFrame, judged: DataFrame, models: Sequence[ModelSpec], salted: bool | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """Add `cached` and `to_ask`: the panel's models that have answered the prompt, and the others.

    One row per sample: a text crosses at most one exchange, by the prompt's hash, and is
    repeated per model only after it, by an explode in the task that asks. The lookup side
    has one row per answered prompt, of no more ids than the panel.
    """
    panel = F.array(*[F.lit(m.model_id) for m in check_panel(models)])
    found = answered(judged).groupBy("prompt_sha256").agg(F.collect_set("model_id").alias("_answered"))
    spread = [c for c in ("line_no", *PAIR) if c in prompts.columns]
    marked = lookup_join(prompts, found, "prompt_sha256", "left", spread, salted=salted, hot=hot)
    known = F.coalesce("_answered", F.array().cast("array<string>"))
    return marked.withColumns({"cached": F.array_intersect(panel, known), "to_ask": F.array_except(panel, known)}).drop("_answered")


def split_stored(prompts: DataFrame, table: str, models: Sequence[ModelSpec]) -> DataFrame:
    """`split_panel` against a table of `write_cache`: no stored row is shuffled, and no text that can't be in it.

    Prompts unknown to the table's filter are asked of the whole panel where they are; the others meet
    the table bucket by bucket.
    """
    spark = prompts.sparkSession
    panel = F.array(*[F.lit(m.model_id) for m in check_panel(models)])
    marked = prompts.withColumn("_known", may_be_stored(spark, table))
    met = split_panel(marked.where("_known").drop("_known"), read_cache(spark, table), models, salted=False)
    new = marked.where("NOT _known").drop("_known").withColumns({"cached": F.array().cast("array<string>"), "to_ask": panel})
    return met.unionByName(new)


def mark_cached(requests: DataFrame, judged: DataFrame, salted: bool | None = None) -> DataFrame:
    """Add `cache_hit`: whether the same model has answered the same prompt before.

    `judged` carries `prompt_sha256`. Only its distinct keys take part, so
    neither repeated prompts nor repeated runs multiply rows. A stored row without
    `raw_text` is no answer: its request is asked again.
    """
    keys = answered(judged).select(*CACHE_KEY).distinct().withColumn("cache_hit", F.lit(True))
    spread = [c for c in ("line_no", *PAIR) if c in requests.columns]
    marked = lookup_join(requests, keys, CACHE_KEY, "left", spread, salted=salted)
    return marked.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def cache_split(
    requests: DataFrame, judged: DataFrame, salted: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of `mark_cached`."""
    marked = mark_cached(requests, judged, salted)
    return marked.where("cache_hit"), marked.where("NOT cache_hit")


def answer_from_cache(hits: DataFrame, judged: DataFrame, salted: bool | None = None) -> DataFrame:
    """Completions for the hits, from the latest stored answer to the prompt, with what that answer took."""
    judged = answered(judged)
    answers = ["raw_text", "version", "latency_ms", "retries", "cost_estimate"]
    order = [F.col("run_id")] if "run_id" in judged.columns else []
    latest = (
        judged.groupBy(*CACHE_KEY)
        .agg(F.max(F.struct(*order, *answers)).alias("_a"))
        .select(*CACHE_KEY, *[F.col(f"_a.{c}").alias(c) for c in answers])
    )
    spread = [c for c in ("line_no", *PAIR) if c in hits.columns]
    return lookup_join(hits.drop("request"), latest, CACHE_KEY, "inner", spread, salted=salted)


Completion = dict[str, Any]
Completer = Callable[[dict[str, Any]], Completion]

def by_provider(factories: dict[str, Callable[[], Completer]]) -> Callable[[], Completer]:
    """A completer factory that passes each request to its provider's completer."""

    def factory() -> Completer:
        completers: dict[str, Completer] = {}

        def complete(request: dict[str, Any]) -> Completion:
            name = request["provider"]
            if name not in factories:
                raise NotImplementedError(f"No completer given for provider {name}")
            if name not in completers:
                completers[name] = factories[name]()
            return completers[name](request)

        return complete

    return factory


_JUDGED = "raw_text string, version string, latency_ms double, retries int, cost_estimate double"


# Calls a task keeps waiting at once.
CONCURRENT_CALLS = 8


def judge(
    requests: DataFrame, completer_factory: Callable[[], Completer], partitions: int | None = None, concurrent: int = 1,
    per_second: float | None = None,
) -> DataFrame:
    """Ask the model for every request; one completer per partition.

    The completer takes the request as a dict and returns a dict with
    `raw_text` and optionally `version`, `retries`, `cost_estimate` and
    `latency_ms` (measured here if absent). An exception fails the task and
    finally the job. A task run again repeats its calls: write the result before
    using it twice.

    Calls wait on the model, so the rows are spread evenly over `partitions`
    tasks, whatever the partitioning of the joins before: by default four per
    core; 0 leaves the rows where they are. `concurrent` calls of a task wait at once (the completer
    must then be safe in threads); rows keep their order.
    """
    kept = [c for c in requests.columns if c != "request"]
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema if f.name in kept
    )
    if partitions is None:
        partitions = 4 * requests.sparkSession.sparkContext.defaultParallelism
    if partitions:
        # By the row's own values: a task run again gets the same rows.
        requests = requests.repartition(partitions, *[c for c in ("line_no", *PAIR, "model_id") if c in kept])

    at_once = requests.sparkSession.sparkContext.defaultParallelism
    spacing = (min(partitions, at_once) if partitions else at_once) / per_second if per_second else 0.0

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor
        from threading import Lock

        complete = completer_factory()
        turn, free_at = Lock(), [time.perf_counter()]

        def wait() -> None:
            with turn:
                now = time.perf_counter()
                begin = max(now, free_at[0])
                free_at[0] = begin + spacing
            time.sleep(begin - now)

        def one(request: Any) -> Completion:
            if spacing:
                wait()
            begin = time.perf_counter()
            answer = complete(request.asDict(True) if hasattr(request, "asDict") else request)
            spent = (time.perf_counter() - begin) * 1000.0
            return {
                "raw_text": answer["raw_text"],
                "version": answer.get("version"),
                "latency_ms": answer.get("latency_ms", spent),
                "retries": answer.get("retries", 0),
                "cost_estimate": answer.get("cost_estimate"),
            }

        with ThreadPoolExecutor(concurrent) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch["request"]) if concurrent > 1 else map(one, batch["request"]))
                answers = pd.DataFrame(
                    rows, columns=["raw_text", "version", "latency_ms", "retries", "cost_estimate"], index=batch.index
                )
                judged = pd.concat([batch[kept], answers], axis=1)
                del batch, rows, answers  # else their prompts stay while the next batch is read
                yield judged

    return requests.mapInPandas(ask, f"{schema}, {_JUDGED}")


def slice_of(columns: Sequence[str], slices: int) -> Column:
    """Which of the slices a request belongs to, by a hash of its own key."""
    key = [c for c in ("line_no", *PAIR, "model_id") if c in columns]
    return F.pmod(F.xxhash64(*key), F.lit(slices))


def judge_slices(
    requests: DataFrame, completer_factory: Callable[[], Completer], write: Callable[[DataFrame, int], DataFrame],
    slices: int = 1, partitions: int | None = None, concurrent: int = CONCURRENT_CALLS, per_second: float | None = None,
    finished: Mapping[int, DataFrame] | None = None,
) -> list[DataFrame]:
    """`judge` in slices, each written by `write(rows, number)` before the next is asked.

    Requests are dealt by `slice_of`, so a rerun deals them alike. `finished` holds the slices an earlier
    attempt has written: they are taken as they are, and nothing of them is asked again.
    """
    part = slice_of(requests.columns, slices)
    done = dict(finished or {})
    for k in range(slices):
        if k not in done:
            done[k] = write(judge(requests.where(part == k), completer_factory, partitions, concurrent, per_second), k)
    return [done[k] for k in range(slices)]


def judge_offline(requests: DataFrame, completions: DataFrame, salted: bool | None = None) -> DataFrame:
    """Completions from a table keyed by (query_id, docid, model_id), e.g. a batch answer.

    A request without completion keeps a null raw_text: its label is null with a
    warning, and `validate_judgements` rejects it.
    """
    key = [*PAIR, "model_id"]
    extra = [c for c in ("raw_text", "version", "latency_ms", "retries", "cost_estimate", "confidence")
             if c in completions.columns]
    answered = completions.select(*key, *extra)
    kept = requests.drop("request")
    return lookup_join(kept, answered, key, "left", [c for c in ("line_no", *key) if c in kept.columns], salted=salted)


def to_judgement(df: DataFrame, response_parser: str = "parse_thomas_response") -> DataFrame:
    """Parse the raw answers and assemble judgement rows.

    model_id stays the registry's id, by which weights are keyed; `version` is
    the model the answer names, else the provider's id.
    """
    # Out of a generator, so that a later filter on the label does not parse again.
    parsed = df.select("*", F.explode(F.array(parser(response_parser)(F.col("raw_text")))).alias("_p"))
    given = set(df.columns)

    def field(name: str, default: Any, kind: str):
        return F.coalesce(F.col(name), F.lit(default)).cast(kind) if name in given else F.lit(default).cast(kind)

    fallback = F.col("provider_model") if "provider_model" in given else F.lit(None)
    confidence = F.col("_p.confidence")
    if "confidence" in given:
        confidence = F.coalesce(confidence, F.col("confidence"))
    extra = [c for c in ("line_no", "run_id", "prompt_sha256") if c in given]
    return parsed.select(
        "model_id",
        "provider",
        F.coalesce(F.col("version") if "version" in given else F.lit(None), fallback).cast("string").alias("version"),
        *PAIR,
        F.col("_p.label").alias("label"),
        F.col("_p.score").alias("score"),
        confidence.alias("confidence"),
        F.col("_p.rationale").alias("rationale"),
        "raw_text",
        "latency_ms",
        field("retries", 0, "int").alias("retries"),
        (F.col("cost_estimate") if "cost_estimate" in given else F.lit(None)).cast("double").alias("cost_estimate"),
        F.col("_p.warnings").alias("warnings"),
        (F.col("cache_hit") if "cache_hit" in given else F.lit(None)).cast("boolean").alias("cache_hit"),
        *extra,
    )


def validate_judgements(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): ranges of label, score and confidence, required columns."""
    required = ["model_id", "provider", *PAIR, "raw_text", "latency_ms", "retries", "warnings"]
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    reason = (
        F.when(missing != "", F.concat(F.lit("Missing required: "), missing))
        .when(~F.col("label").isin(0, 1, 2), F.lit("Invalid label"))
        .when(~F.col("score").between(0.0, 2.0), F.lit("Invalid score"))
        .when(~F.col("confidence").between(0.0, 1.0), F.lit("Invalid confidence"))
    )
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def infer_summary(judgements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Judgements, judgements without label, and mean latency (0 for no rows)."""
    return judgements.groupBy(*by).agg(
        F.count(F.lit(1)).alias("judgement_count"),
        F.count_if(F.col("label").isNull()).alias("error_count"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )
