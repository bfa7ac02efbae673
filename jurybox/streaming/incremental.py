"""The infer stage as a stream of files.

Judgements are kept as they come: a stopped run goes on with the files it has
not finished, and new sample files are judged without asking again for old
ones. All operators are those of the batch stage; none keeps state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jurybox import schemas
from jurybox.functions.prompts import prompt, render_prompt
from jurybox.operators import requests as rq
from jurybox.session import checkpoint_dir
from jurybox.sources.registry import MODELS, ModelSpec, models_df


CORRUPT = "_corrupt_record"
REQUIRED = ("query_id", "query_text", "docid", "doc")


def _sample_stream(spark: SparkSession, samples_path: str, files_per_batch: int) -> DataFrame:
    schema = T.StructType([*schemas.SAMPLES.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(samples_path)


def _bad() -> Column:
    bad = F.col(CORRUPT).isNotNull()
    for name in REQUIRED:
        bad = bad | F.col(name).isNull()
    return bad


def _valid(stream: DataFrame) -> DataFrame:
    """Rows that can be asked: no broken line becomes a request without content."""
    return stream.where(~_bad())


def reject_new_samples(
    spark: SparkSession, samples_path: str, out_path: str, checkpoint: str | None = None, files_per_batch: int = 100,
) -> StreamingQuery:
    """The lines of new sample files that `judge_new_samples` leaves out: source, reason and raw text, as Parquet."""
    stream = _sample_stream(spark, samples_path, files_per_batch).where(_bad())
    fields = F.to_json(F.struct(*schemas.SAMPLES.names))
    rejects = stream.select(
        F.lit("samples").alias("source"), F.when(F.col(CORRUPT).isNotNull(), "Invalid JSON").otherwise("Invalid sample").alias("reason"),
        F.coalesce(F.col(CORRUPT), fields).alias("raw"))
    name = hashlib.sha256(out_path.rstrip("/").encode()).hexdigest()[:24]
    return (
        rejects.writeStream.format("parquet").option("path", out_path)
        .option("checkpointLocation", f"{checkpoint_dir(spark, checkpoint)}/reject/{name}").trigger(availableNow=True).start()
    )


def judge_new_samples(
    spark: SparkSession, samples_path: str, out_path: str, completer_factory: Callable[[], rq.Completer],
    models: Sequence[ModelSpec] = MODELS, prompt_name: str = "thomas-et-al-prompt",
    variables: Mapping[str, Any] | None = None, checkpoint: str | None = None, files_per_batch: int = 100,
) -> StreamingQuery:
    """Judge the valid rows of all sample files not judged yet, then stop; Parquet judgements by model."""
    stream = _valid(_sample_stream(spark, samples_path, files_per_batch)).drop(CORRUPT)
    registry = rq.check_models(models_df(spark, models))
    ready, _ = rq.attach_model(rq.fan_out(stream, models), registry)
    requests = rq.build_requests(render_prompt(ready, prompt_name, **(variables or {})))
    judged = rq.to_judgement(rq.judge(requests, completer_factory), prompt(prompt_name).response_parser or "parse_label")
    name = hashlib.sha256(out_path.rstrip("/").encode()).hexdigest()[:24]  # one checkpoint per output
    return (
        judged.writeStream.format("parquet")
        .partitionBy("model_id")
        .option("path", out_path)
        .option("checkpointLocation", f"{checkpoint_dir(spark, checkpoint)}/judge/{name}")
        .trigger(availableNow=True)
        .start()
    )
