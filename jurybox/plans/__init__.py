"""The four stages: each reads tables, writes its run's tables and a manifest."""

from jurybox.plans.stages import RunResult, aggregate, evaluate, infer, ingest

__all__ = ["RunResult", "aggregate", "evaluate", "infer", "ingest"]
