"""Model registry, panel weights and dataset splits as small typed tables.

Configuration is rows given by the caller; the tables are local relations, whose
size Spark knows, so joins with them are broadcast without a hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class ModelSpec:
    model_id: str
    provider: str
    context_window: int
    default_params: Mapping[str, str] = field(default_factory=dict)
    capabilities: Mapping[str, str] = field(default_factory=dict)
    hf_endpoint_url: str | None = None
    hf_model_name: str | None = None
    openrouter_model_id: str | None = None


# Providers, sampling defaults, the shipped models and weights.
PROVIDERS = ("hf", "ollama", "openrouter")
TEMPERATURE = 0.0
MAX_TOKENS = 256
TIMEOUT_SECONDS = 30
_PARAMS = {"temperature": "0.0", "max_tokens": "256"}
MODELS = (
    ModelSpec("gpt-oss-20b", "openrouter", 8192, _PARAMS, {"multilingual": "true"},
              openrouter_model_id="openai/gpt-oss-20b:free"),
    ModelSpec("qwen-0.5b", "openrouter", 8192, _PARAMS, {"multilingual": "true"},
              openrouter_model_id="qwen/qwen-0.5b-chat"),
    ModelSpec("phi3-mini", "hf", 4096, _PARAMS, {"multilingual": "true"},
              hf_model_name="microsoft/Phi-3-mini-4k-instruct"),
    ModelSpec("tinyllama", "ollama", 2048, _PARAMS, {"multilingual": "false"}),
)
DEFAULT_WEIGHT = 1.0
WEIGHTS = {"phi3-mini": 1.0, "tinyllama": 1.0}


def check_panel(specs: Sequence[ModelSpec]) -> Sequence[ModelSpec]:
    ids = [s.model_id for s in specs]
    if len(set(ids)) != len(ids):
        raise ValueError("model_id must be unique in the registry")
    return specs


def model(model_id: str, specs: Sequence[ModelSpec] = MODELS) -> ModelSpec:
    for spec in specs:
        if spec.model_id == model_id:
            return spec
    known = "\n".join(f"  - {s.model_id}" for s in specs)
    raise KeyError(f"Model config not found: {model_id}\nAvailable configs:\n{known}")


def models_df(spark: SparkSession, specs: Sequence[ModelSpec] = MODELS) -> DataFrame:
    rows = [vars(s) | {"default_params": list(s.default_params.items()),
                       "capabilities": list(s.capabilities.items())} for s in check_panel(specs)]
    text_map = pa.map_(pa.string(), pa.string())
    schema = pa.schema([
        ("model_id", pa.string()), ("provider", pa.string()), ("context_window", pa.int32()),
        ("default_params", text_map), ("capabilities", text_map),
        ("hf_endpoint_url", pa.string()), ("hf_model_name", pa.string()), ("openrouter_model_id", pa.string()),
    ])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def weights_df(spark: SparkSession, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(model_id, weight DECIMAL(18,6)); decimals keep ties exact."""
    table = pa.table({"model_id": pa.array(list(weights), pa.string()),
                      "weight": pa.array([float(w) for w in weights.values()], pa.float64())})
    return spark.createDataFrame(table).withColumn("weight", F.col("weight").cast("decimal(18,6)"))
