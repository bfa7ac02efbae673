"""Declared row types of the pipeline tables. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BIGINT, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
BOOLEAN, TIMESTAMP = T.BooleanType(), T.TimestampType()
TEXT_MAP = T.MapType(STRING, STRING)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


QUERIES = _table(query_id=STRING, query_text=STRING)
DOCUMENTS = _table(docid=STRING, doc=STRING)
QRELS = _table(query_id=STRING, docid=STRING, relevance=BIGINT)
REJECTS = _table(source=STRING, line_no=BIGINT, reason=STRING, raw=STRING)

SAMPLES = _table(
    dataset=STRING, query_id=STRING, query_text=STRING, docid=STRING, doc=STRING, gold_relevance=BIGINT
)

JUDGEMENTS = _table(
    model_id=STRING, provider=STRING, version=STRING, query_id=STRING, docid=STRING, label=INT,
    score=DOUBLE, confidence=DOUBLE, rationale=STRING, raw_text=STRING, latency_ms=DOUBLE, retries=INT,
    cost_estimate=DOUBLE, warnings=T.ArrayType(STRING), cache_hit=BOOLEAN, run_id=STRING, prompt_sha256=STRING,
    line_no=BIGINT,
)

SPLITS = _table(
    sample_id=STRING, query=STRING, candidate=STRING, references=T.ArrayType(STRING), gold_label=STRING, metadata=TEXT_MAP,
)

# Fields every log record carries, plus the event fields the reports read.
# Fields beyond these stay reachable through the VARIANT column `fields`.
LOGS = _table(
    event=STRING, cli=STRING, run_id=STRING, git_sha=STRING, level=STRING, logger=STRING,
    timestamp=TIMESTAMP, query_id=STRING, doc_id=STRING, label=INT, latency_ms=DOUBLE, error=STRING,
    error_type=STRING, dataset=STRING, data_dir=STRING, limit=BIGINT, sample_count=BIGINT, model=STRING,
    num_samples=BIGINT,
)

MANIFESTS = _table(
    run_id=STRING, cli_name=STRING, timestamp=TIMESTAMP, cli_args=TEXT_MAP, git_sha=STRING,
    git_clean=BOOLEAN, git_branch=STRING,
)
