"""Operators over logs, judgements and manifests: latency, cost, reports, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.operators.order import percentiles


def filter_events(
    logs: DataFrame, event: str | None = None, level: str | None = None, run_id: str | None = None,
    min_latency_ms: float | None = None,
) -> DataFrame:
    """Log rows by event, level, run, or latency above a bound."""
    for column, wanted in (("event", event), ("level", level), ("run_id", run_id)):
        if wanted is not None:
            logs = logs.where(F.col(column) == wanted)
    if min_latency_ms is not None:
        logs = logs.where(F.col("latency_ms") > min_latency_ms)
    return logs


def describe_latency(df: DataFrame, by: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max."""
    extra = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return percentiles(df, value, points, by, extra).select(
        *by, "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def cost_latency(judgements: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Rows, latency (mean, median, 95 %), retries and cost per group.

    Answers that came from the cache were counted by the run that asked; they are left out.
    """
    if "cache_hit" in judgements.columns:
        judgements = judgements.where(~F.coalesce("cache_hit", F.lit(False)))
    extra = [
        F.count(F.lit(1)).alias("n"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("cost"),
    ]
    points = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    return percentiles(judgements, "latency_ms", points, by, extra)


def count_errors(logs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return logs.groupBy(*by).agg(F.count_if(F.col("level") == "error").alias("error_count"))


def mean_latency(logs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean latency of the successful calls."""
    return logs.groupBy(*by).agg(
        F.avg(F.when(F.col("event") == "inference_success", F.col("latency_ms"))).alias("mean_latency_ms")
    )


def run_report(logs: DataFrame) -> DataFrame:
    """One row per run: entries, events, input settings, samples, sha, start and end.

    Entries are summed per (run, event) first; a run's event names are few.
    """
    first = ("dataset", "data_dir", "limit", "sample_count", "git_sha")
    present = [c for c in first if c in logs.columns]
    per_event = logs.groupBy("run_id", "event").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in present],
        F.min("timestamp").alias("started"),
        F.max("timestamp").alias("completed"),
    )
    return per_event.groupBy("run_id").agg(
        F.sum("n").alias("entries"),
        F.array_sort(F.collect_list("event")).alias("events"),
        *[F.max(c).alias(c) for c in present],
        F.min("started").alias("started"),
        F.max("completed").alias("completed"),
    )


def warning_counts(judgements: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """How often each warning occurs per group; the kind is the text up to the first colon."""
    kind = F.substring_index("warning", ":", 1).alias("warning")
    return (
        judgements.select(*by, F.explode("warnings").alias("warning"))
        .groupBy(*by, kind)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def problem_summary(judgements: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Warnings, retries, missing labels and cost per group."""
    return judgements.groupBy(*by).agg(
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("warnings"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        F.count_if(F.col("label").isNull()).alias("errors"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("cost"),
    )


def row_text(columns: Sequence[str]) -> Column:
    """A row as one text that no other row has: each column's bytes with their number before them, N for null."""
    as_text = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.lit("V"), F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("N")) for t in as_text]
    return F.concat(*parts)


def dataset_checksum(df: DataFrame) -> DataFrame:
    """(n_rows, checksum): the sum modulo 2^64 of the first 64 bits of every row's MD5.

    The same whatever the order of rows; a repeated row counts as often as it comes, null is not the
    empty text. Any engine that has MD5 can compute it from `row_text`; columns are cast to text, so
    fractions should be decimals or rounded first.
    """
    digits = F.conv(F.left(F.md5(row_text(df.columns).cast("binary")), F.lit(16)), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(digits), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (total % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("checksum"))


def list_runs(manifests: DataFrame, stage: str | None = None) -> DataFrame:
    """Run ids, newest first; one row per run of each stage. Takes `read_runs` or `read_manifests`."""
    runs = manifests if stage is None else manifests.where(F.col("cli_name") == stage)
    return runs.select("cli_name", "run_id").distinct().select("run_id").orderBy(F.desc("run_id"))
