"""Readers of samples, judgements, ensembles, logs and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurybox import schemas
from jurybox.functions.text import blank, strip, to_bigint
from jurybox.sources.lines import read_lines
from jurybox.sources.parsers import (
    DATASETS, Parsed, check, is_text, json_object, mark, parsed_lines, split_marked, variant_text,
)
from jurybox.sources.sinks import children


def parse_samples(lines: DataFrame) -> Parsed:
    """NDJSON lines to samples; every field must be present and of its type.

    An integer written as text or as a whole float is taken, as the declared
    row type allows; a number in a text field is not.
    """
    names = [f.name for f in schemas.SAMPLES]
    value = F.col("value")
    parts = parsed_lines(lines, ~blank(value), _o=json_object(value, names)).withColumn("_s", F.get("_o", F.lit(0)))
    text = [c for c in names if c != "gold_relevance"]
    as_text = variant_text("_s.gold_relevance")
    kind = F.expr("schema_of_variant(_s.gold_relevance)")
    gold = F.when(kind == "STRING", to_bigint(strip(as_text))).when(
        kind != "BOOLEAN", to_bigint(F.regexp_replace(as_text, r"\.0*$", ""))
    )
    known = F.coalesce(variant_text("_s.dataset").isin(*sorted(set(DATASETS.values()))), F.lit(False))
    ok = is_text(*[f"_s.{c}" for c in text]) & known & gold.isNotNull()
    reason = F.when(F.col("_s").isNull(), F.lit("Invalid JSON")).when(~ok, F.lit("Invalid sample"))
    good = [variant_text(f"_s.{c}").alias(c) for c in text]
    return split_marked(mark(parts, reason, [*good, gold.alias("gold_relevance")]), "samples")


def read_samples(spark: SparkSession, path: str) -> Parsed:
    return parse_samples(read_lines(spark, path))


def _parse_records(lines: DataFrame, schema: T.StructType, required: Sequence[str], source: str, reason: str) -> Parsed:
    """NDJSON lines to rows of `schema`: (good, rejects). A line is rejected if it is no single JSON
    object, or if a required field is missing or not of its type."""
    value = F.col("value")
    parts = parsed_lines(lines, ~blank(value), _v=F.try_parse_json(value), _r=F.from_json(value, schema))
    is_object = F.coalesce(F.expr("schema_of_variant(_v)").startswith("OBJECT"), F.lit(False))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"_r.{name}").isNull()
    why = F.when(~is_object, F.lit("Invalid JSON")).when(missing, F.lit(reason))
    # The file's own line_no gives way to a field of that name.
    fields = [F.col(f"_r.{f.name}").alias(f.name if f.name != "line_no" else "_line_no") for f in schema]
    good, rejects = split_marked(mark(parts, why, fields), source)
    if "line_no" in schema.names:
        good = good.drop("line_no").withColumnRenamed("_line_no", "line_no")
    return good, rejects


def parse_judgements(lines: DataFrame) -> Parsed:
    """Judgements as `write_judgements` writes them, with run_id, prompt_sha256 and line_no where given."""
    return _parse_records(lines, schemas.JUDGEMENTS, ["model_id", "query_id", "docid"], "judgements", "Invalid judgement")


def parse_splits(
    lines: DataFrame, split: str | None = None, name: str | None = None, version: str | None = None,
    schema: T.StructType = schemas.SPLITS, required: Sequence[str] = ("sample_id", "query"),
) -> Parsed:
    """Canonical samples of one split, with references and metadata, and the split's and dataset's name."""
    good, rejects = _parse_records(lines, schema, required, "splits", "Invalid sample")
    named = {"split": split, "dataset": name, "version": version}
    return good.drop("line_no").withColumns({k: F.lit(v).cast("string") for k, v in named.items()}), rejects


def read_dataset_splits(
    spark: SparkSession, splits: Mapping[str, str], name: str | None = None, version: str | None = None,
    schema: T.StructType = schemas.SPLITS, strict: bool = True,
) -> DataFrame:
    """JSONL per split. A bad line raises; with `strict=False` it is left out, see `parse_splits` for the rejects."""
    parts = []
    for split, path in splits.items():
        good, rejects = parse_splits(read_lines(spark, path), split, name, version, schema)
        check(rejects, strict)
        parts.append(good)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_judgements(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Judgements of several models: Parquet, or NDJSON by file ending. A bad line raises unless `strict=False`."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    json_paths = [p for p in paths if p.endswith((".ndjson", ".jsonl", ".json"))]
    parts = [spark.read.parquet(p) for p in paths if p not in json_paths]
    for path in json_paths:
        good, rejects = parse_judgements(read_lines(spark, path))
        check(rejects, strict)
        parts.append(good)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def peek(spark: SparkSession, glob: str, n: int = 50) -> DataFrame:
    """The first rows that come to hand, over every run the glob names."""
    return spark.read.option("mergeSchema", True).parquet(glob).limit(n)


def _is_record() -> Column:
    """Whether the line in `value` is one JSON object."""
    return F.coalesce(F.expr("schema_of_variant(try_parse_json(value))").startswith("OBJECT"), F.lit(False))


def parse_logs(lines: DataFrame) -> DataFrame:
    """Typed log fields of the valid records; the whole record stays reachable as VARIANT `fields`."""
    keep = ~blank(F.col("value")) & _is_record()
    record = F.when(keep, F.array(F.from_json("value", _raw_times(schemas.LOGS))))
    typed = lines.select("value", F.inline(record)).withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
    return typed.withColumn("fields", F.try_parse_json("value")).drop("value")


def reject_logs(lines: DataFrame) -> DataFrame:
    """The lines `parse_logs` leaves out, in the form of the other parsers' rejects."""
    bad = lines.where(~blank(F.col("value")) & ~_is_record())
    number = F.col("line_no") if "line_no" in lines.columns else F.lit(None)
    return bad.select(F.lit("logs").alias("source"), number.cast("bigint").alias("line_no"), F.lit("Invalid JSON").alias("reason"), F.col("value").alias("raw"))


def _raw_times(schema: T.StructType) -> T.StructType:
    """Timestamps as text: a cast takes every ISO form, the JSON reader only some."""
    text = T.StringType()
    return T.StructType([T.StructField(f.name, text if f.dataType == T.TimestampType() else f.dataType) for f in schema])


def read_logs(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    return parse_logs(spark.read.text(glob))


def read_manifests(
    spark: SparkSession, base: str, stage: str | None = None, run_id: str | None = None
) -> DataFrame:
    """One row per `runs/<stage>/<run_id>/manifest.json`, all fields in `manifest`."""
    root = base.rstrip("/")
    pattern = f"{root}/runs/{stage or '*'}/{run_id or '*'}/manifest.json"
    try:
        files = spark.read.text(pattern, wholetext=True)
    except Exception as error:  # the path pattern matches nothing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        if run_id is not None:
            raise FileNotFoundError(f"Manifest not found: {pattern}") from None
        files = spark.createDataFrame([], "value string")
    return files.select(
        F.from_json("value", _raw_times(schemas.MANIFESTS)).alias("_m"), F.try_parse_json("value").alias("manifest")
    ).select("_m.*", "manifest").withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def read_runs(spark: SparkSession, base: str, stage: str | None = None) -> DataFrame:
    """(cli_name, run_id, finished, manifest): every run folder, by the folder's own names.

    The folders are listed through the file system they are on. A run that ended without a manifest
    shows with `finished` false; a manifest counts for the folder it lies in, whatever it says.
    """
    root = f"{base.rstrip('/')}/runs"
    stages = children(spark, root) if stage is None else [stage]
    names = [(s, r) for s in stages for r in children(spark, f"{root}/{s}")]
    columns = [pa.array(c, pa.string()) for c in (zip(*names) if names else ((), ()))]
    folders = spark.createDataFrame(pa.table(dict(zip(("cli_name", "run_id"), columns))))
    if not any("manifest.json" in children(spark, f"{root}/{s}/{r}") for s, r in names):
        return folders.select("*", F.lit(False).alias("finished"), F.lit(None).cast("variant").alias("manifest"))
    files = spark.read.text(f"{root}/{stage or '*'}/*/manifest.json", wholetext=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    known = files.select(F.col("value"), F.when(F.col("_metadata.file_path").endswith("/manifest.json"), F.lit(2)).otherwise(F.lit(3)).alias("up"), place.alias("p"))
    known = known.select(F.element_at("p", -1 - F.col("up")).alias("cli_name"), F.element_at("p", -F.col("up")).alias("run_id"),
                         F.try_parse_json("value").alias("manifest"))
    return folders.join(known, ["cli_name", "run_id"], "left").select(
        "cli_name", "run_id", F.col("manifest").isNotNull().alias("finished"), "manifest")
