"""Relevance judging with a panel of language models, as Spark DataFrame operators.

Stages (see :mod:`jurybox.plans`): ingest -> infer -> aggregate -> evaluate.
Every stage is built from the operators in :mod:`jurybox.operators`, which take
and return DataFrames and can be used on their own.
"""
