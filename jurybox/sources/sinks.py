"""Sinks: NDJSON, Parquet, metrics, previews and run manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_path(base: str, stage: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/runs/{stage}/{run_id}"


def write_ndjson(
    df: DataFrame, path: str, order_by: str | Sequence[str] | None = None, drop: Sequence[str] = (), mode: str = "error"
) -> None:
    """One object per line, nulls written. `order_by` orders lines through all files."""
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    df.drop(*drop).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_samples(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Samples in the order of their qrels: ranges of line numbers become files in order, sorted inside."""
    ordered = "line_no" if "line_no" in samples.columns else None
    write_ndjson(samples, path, ordered, drop=["line_no"], mode=mode)


def write_judgements(judgements: DataFrame, path: str, mode: str = "error") -> None:
    """Judgements in the order of their samples, those of one sample by model."""
    ordered = [c for c in ("line_no", "model_id") if c in judgements.columns] if "line_no" in judgements.columns else None
    write_ndjson(judgements, path, ordered, drop=["line_no"], mode=mode)


def write_run_parquet(
    df: DataFrame, base: str, stage: str, run_id: str, table: str,
    partition_by: Sequence[str] | None = None, mode: str = "error",
) -> str:
    """`<base>/runs/<stage>/<run_id>/<table>.parquet`, e.g. partitioned by model_id."""
    path = f"{run_path(base, stage, run_id)}/{table}.parquet"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_metrics(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """A metrics table of one row (or one per slice) as a single JSON file."""
    write_ndjson(metrics.coalesce(1), path, mode=mode)


def write_head(df: DataFrame, path: str, n: int, order_by: str | Sequence[str], mode: str = "error") -> None:
    """Preview of the first n rows."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    write_ndjson(df.orderBy(*keys).limit(n), path, mode=mode)


def append_manifest(
    spark: SparkSession, base: str, run_id: str, stage: str, args: Mapping[str, Any],
    metadata: DataFrame | None = None, git: Mapping[str, Any] | None = None, mode: str = "error",
) -> str:
    """Write the manifest of a run; the metadata row's columns override earlier keys.

    `metadata` is a one-row DataFrame, such as the stage's summary.
    """
    git = {"git_sha": "unknown", "git_clean": False, "git_branch": "unknown", **(git or {})}
    arg_pairs = [F.lit(x) for k, v in args.items() for x in (k, None if v is None else str(v))]
    row = metadata if metadata is not None else spark.range(1).select()
    base_columns = {
        "run_id": F.lit(run_id),
        "cli_name": F.lit(stage),
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        "cli_args": F.create_map(*arg_pairs) if arg_pairs else F.create_map().cast("map<string,string>"),
        **{k: F.lit(v) for k, v in git.items()},
    }
    columns = [
        F.col(name) if name in row.columns else value.alias(name) for name, value in base_columns.items()
    ] + [F.col(c) for c in row.columns if c not in base_columns]
    path = f"{run_path(base, stage, run_id)}/manifest.json"
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    row.select(body.alias("value")).coalesce(1).write.mode(mode).text(path)
    return path


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order, by the file system the path belongs to; none if it is not there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


@dataclass(frozen=True)
class SliceLog:
    """Slices of a long job as tables of their own, and a record of each that is written whole.

    The record is written after its slice, so a slice without one is written anew. It holds what the job
    was asked to do: a rerun that asks for something else is refused, it would mix the two.
    """

    spark: SparkSession
    root: str
    slices: int
    task: Mapping[str, Any]

    def _path(self, number: int) -> str:
        return f"{self.root}/slice-{number:05d}.parquet"

    def _record(self) -> str:
        return json.dumps({"slices": self.slices, **self.task}, sort_keys=True)

    def finished(self) -> dict[int, DataFrame]:
        """The slices that have a record, by number."""
        names = [n for n in children(self.spark, f"{self.root}/commits") if n.isdigit()]
        names = [n for n in names if "_SUCCESS" in children(self.spark, f"{self.root}/commits/{n}")]
        if not names:
            return {}
        records = self.spark.read.text([f"{self.root}/commits/{n}" for n in names])
        if {r["value"] for r in records.collect()} != {self._record()}:
            raise ValueError(f"The finished slices under {self.root} belong to a run with other settings")
        return {int(n): self.spark.read.parquet(self._path(int(n))) for n in names}

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        """Write a slice, then its record."""
        rows.write.mode("overwrite").parquet(self._path(number))
        record = self.spark.range(1).select(F.lit(self._record()).alias("value"))
        record.coalesce(1).write.mode("overwrite").text(f"{self.root}/commits/{number}")
        return self.spark.read.parquet(self._path(number))
