"""Pipeline tables derived from the driver's tables; the SQL twins are in `sql.py`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.sources.registry import ModelSpec
from jurybox.sources.parsers import parse_documents, parse_qrels, parse_queries

# Panel of the generated judgements: multiplier of the generator and weight.
PANEL = {"gpt-oss-20b": (1, 2.0), "qwen-0.5b": (5, 1.0), "phi3-mini": (7, 1.0)}
PANEL_WEIGHTS = {m: w for m, (_, w) in PANEL.items()}
PANEL_MODELS = (
    ModelSpec("gpt-oss-20b", "openrouter", 8192, {"temperature": "0.0", "max_tokens": "256"},
              openrouter_model_id="openai/gpt-oss-20b:free"),
    ModelSpec("qwen-0.5b", "openrouter", 2048, {}, openrouter_model_id="qwen/qwen-0.5b-chat"),
    ModelSpec("phi3-mini", "hf", 4096, {"max_tokens": "128"}, hf_model_name="microsoft/Phi-3-mini-4k-instruct"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes: in the shared folder the session names, on one machine in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='jurybox-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query_id(doc_id: Column) -> Column:
    return (doc_id % 50 + F.when(doc_id % 11 == 0, 1_000_000).otherwise(0)).cast("string")


def docid(doc_id: Column) -> Column:
    return (doc_id + F.when(doc_id % 7 == 0, 10_000_000).otherwise(0)).cast("string")


def relevance(toxic: Column, quality: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def query_lines(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf, "benchmark").select(
        (F.col("item_id") + 1).alias("line_no"),
        F.concat(F.col("item_id").cast("string"), F.lit("\t"), text).alias("value"),
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("doc")))
    return table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("line_no"), body.alias("value"))


def qrel_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    value = F.concat_ws(" ", query_id(d), relevance(F.col("toxic"), F.col("quality")).cast("string"), docid(d))
    return table(spark, sf, "labels").select((d + 1).alias("line_no"), value.alias("value"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return parse_queries(query_lines(spark, sf))[0]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return parse_documents(document_lines(spark, sf))[0]


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    return parse_qrels(qrel_lines(spark, sf))[0]


def completions(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """One raw answer per label row and model; `shift` gives another run's answers."""
    panel = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(k).alias("k")) for m, (k, _) in PANEL.items()])
    d, k = F.col("doc_id"), F.col("k")
    r = (d * k + F.col("quality") + F.expr("doc_id div k") + shift) % 6
    raw = (
        F.when(r <= 2, F.concat(F.lit('{"O": '), r.cast("string"), F.lit("}")))
        .when(r == 3, F.lit("cannot judge this page"))
        .when(r == 4, F.lit('{"O": 7}'))
        .otherwise(F.lit('Sure: {"M": 1, "T": 2, "O": 1} done'))
    )
    return (
        table(spark, sf, "labels")
        .select("doc_id", "quality", "toxic", F.inline(panel))
        .select(
            d.alias("doc_id"),
            query_id(d).alias("query_id"),
            docid(d).alias("docid"),
            "model_id",
            raw.alias("raw_text"),
            F.lit(None).cast("string").alias("version"),
            (100 + (d * k) % 400).cast("double").alias("latency_ms"),
            (d % 3).cast("int").alias("retries"),
            ((d % 1000).cast("double") * F.lit(0.000001)).alias("cost_estimate"),
            (((d * k) % 101).cast("double") / F.lit(100.0).cast("double")).alias("confidence"),
            relevance(F.col("toxic"), F.col("quality")).cast("bigint").alias("gold_relevance"),
        )
    )


def judgements(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """Completions parsed into judgements, with a run id."""
    from jurybox.operators.requests import to_judgement

    rows = completions(spark, sf, shift).withColumn("provider", F.lit("openrouter"))
    return to_judgement(rows).withColumn("run_id", F.lit(f"run_{9 - shift}"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold rows for the generated judgements: every qrel, joined or not."""
    return qrels(spark, sf).withColumnRenamed("relevance", "gold_relevance")


def log_lines(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    error = F.col("event_type") == "error"
    record = F.struct(
        F.when(error, "inference_failed").otherwise("inference_success").alias("event"),
        F.lit("infer").alias("cli"),
        F.concat(F.lit("run_"), (F.col("user_id") % 10).cast("string")).alias("run_id"),
        F.lit("0000000").alias("git_sha"),
        F.when(error, "error").otherwise("info").alias("level"),
        F.lit("infer").alias("logger"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.col("value").alias("latency_ms"),
        F.col("event_type").alias("kind"),
    )
    return table(spark, sf, "events").select(*keep, F.to_json(record).alias("value"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    from jurybox.sources.readers import parse_logs

    return parse_logs(log_lines(spark, sf))
