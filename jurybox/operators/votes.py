"""Aggregate operators: weighted vote, agreement, flags, disagreement."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.functions.text import sample_id
from jurybox.operators.joins import lookup_join

PAIR = ["query_id", "docid"]
LABELS = (0, 1, 2)
WEIGHT = "decimal(18,6)"

# What a vote carries through the shuffle: no raw text.
_VOTE_FIELDS = [
    "label", "score", "confidence", "latency_ms", "retries", "cost_estimate", "warnings", "provider", "version", "rationale",
]


def one_vote(judgements: DataFrame) -> DataFrame:
    """One judgement per (query_id, docid, model_id): that of the latest run_id.

    Within a run the highest line_no counts, then the order of the values, so
    the choice does not depend on row order. The maximum is combined on the map
    side: copies of one judgement never meet in one task.
    """
    order = [c for c in ("run_id", "line_no") if c in judgements.columns]
    fields = [c for c in _VOTE_FIELDS if c in judgements.columns]
    return (
        judgements.groupBy(*PAIR, "model_id")
        .agg(F.max(F.struct(*order, *fields)).alias("_v"))
        .select(*PAIR, "model_id", *[F.col(f"_v.{c}").alias(c) for c in fields])
    )


def attach_weight(
    judgements: DataFrame, weights: Mapping[str, float] | DataFrame | None = None, default_weight: float = 1.0
) -> DataFrame:
    """Add `weight` DECIMAL(18,6): the model's weight, else the default."""
    default = F.lit(default_weight).cast(WEIGHT)
    if isinstance(weights, DataFrame):
        table = weights.select("model_id", F.col("weight").cast(WEIGHT).alias("weight"))
        joined = lookup_join(judgements, table, "model_id", "left")
        return joined.withColumn("weight", F.coalesce("weight", default))
    if not weights:
        return judgements.withColumn("weight", default)
    # One folded map, whatever the size of the panel.
    table = F.from_json(F.lit(json.dumps({k: str(v) for k, v in weights.items()})), "map<string,string>")
    return judgements.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("model_id")).cast(WEIGHT), default))


def _array_of_votes(votes: DataFrame) -> Column:
    # Bounded by the panel: one vote per model after `one_vote`.
    names = ("model_id", "label", "weight", "confidence", "warnings", "provider", "version", "score", "rationale")
    fields = [c for c in names if c in votes.columns]
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _tally(votes: DataFrame, per_model: bool = False) -> DataFrame:
    """All sums the vote and the agreement measures need, in one aggregate per sample."""
    label, weight = F.col("label"), F.col("weight")
    sums = [F.sum(F.when(label == k, weight)).alias(f"_w{k}") for k in LABELS]
    counts = [F.count_if(label == k).alias(f"_c{k}") for k in LABELS]
    fallback = F.coalesce(F.bool_or(F.size("warnings") > 0), F.lit(False)) if "warnings" in votes.columns else F.lit(False)
    score = F.col("score") if "score" in votes.columns else label.cast("double")
    listed = [_array_of_votes(votes).alias("per_model_votes")] if per_model else []
    return votes.groupBy(*PAIR).agg(
        *sums,
        *counts,
        F.count(F.lit(1)).alias("_votes"),
        F.stddev_pop(score).alias("_spread"),
        fallback.alias("_fallback"),
        *listed,
    )


def _measures() -> dict[str, Column]:
    """Agreement measures over the columns of `_tally`."""
    c = [F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k in LABELS]
    valid = c[0] + c[1] + c[2]
    distinct = sum((F.when(x > 0, 1).otherwise(0) for x in c), F.lit(0))

    def part(x: Column) -> Column:
        p = x / valid
        return F.when(x > 0, -p * F.log2(p)).otherwise(0.0)

    pairs = c[0] * (c[0] - 1) + c[1] * (c[1] - 1) + c[2] * (c[2] - 1)
    highest = F.when(c[2] > 0, 2).when(c[1] > 0, 1).when(c[0] > 0, 0)
    lowest = F.when(c[0] > 0, 0).when(c[1] > 0, 1).when(c[2] > 0, 2)
    return {
        "n_votes": F.coalesce(F.col("_votes"), F.lit(0)).cast("bigint"),
        "n_valid": valid.cast("bigint"),
        "n_distinct": distinct.cast("int"),
        "vote_entropy": F.when(valid > 0, part(c[0]) + part(c[1]) + part(c[2])),
        "pairwise_agreement": F.when(valid >= 2, pairs / (valid * (valid - 1))),
        "label_range": (highest - lowest).cast("int"),
        "score_stddev": F.col("_spread"),
    }


def disagreement_metrics(judgements: DataFrame) -> DataFrame:
    """Counts, entropy (bits), pairwise agreement, label range and score spread per sample.

    Agreement over pairs comes from the label counts; no pair is formed.
    """
    tally = _tally(one_vote(judgements).withColumn("weight", F.lit(1).cast(WEIGHT)))
    return tally.select(*PAIR, *[m.alias(name) for name, m in _measures().items()])


def vote(
    judgements: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    default_weight: float = 1.0,
    n_models: int | None = None,
    low_agreement: float = 0.5,
    samples: DataFrame | None = None,
    per_model: bool = True,
    strategy: str = "weighted_majority",
) -> DataFrame:
    """Weighted majority per (query_id, docid); a tie goes to the lower label.

    Decided from the valid votes. With `samples`, pairs without any judgement
    appear as well. `n_models` is the panel size a full vote has; by default
    the number of models in the judgements.
    """
    votes = attach_weight(one_vote(judgements), weights, default_weight)
    tally = _tally(votes, per_model)
    if samples is not None:
        tally = samples.select(*PAIR).distinct().join(tally, PAIR, "left")
    if n_models is None:
        panel: Column = judgements.select("model_id").distinct().agg(F.count("model_id").alias("n")).scalar()
    else:
        panel = F.lit(n_models)

    w = [F.col(f"_w{k}") for k in LABELS]
    best = F.greatest(*w)  # ignores nulls: labels without a vote
    total = sum((F.coalesce(x, F.lit(0)) for x in w[1:]), F.coalesce(w[0], F.lit(0)))
    winner = F.when(w[0] == best, 0).when(w[1] == best, 1).when(w[2] == best, 2).cast("int")
    at_best = sum((F.when(x == best, 1).otherwise(0) for x in w), F.lit(0))
    confidence = F.when(total > 0, best.cast("double") / total.cast("double")).otherwise(0.0)
    measures = _measures()
    n_valid = measures["n_valid"]

    flags = F.array_compact(
        F.array(
            F.when(at_best > 1, F.lit("tie")),
            F.when((n_valid > 0) & (confidence < low_agreement), F.lit("low_agreement")),
            F.when(F.coalesce("_fallback", F.lit(False)), F.lit("parser_fallback")),
            F.when((n_valid > 0) & (n_valid < panel), F.lit("partial_votes")),
            F.when(n_valid == 0, F.lit("no_valid_votes")),
        )
    )
    listed = []
    if per_model:
        kind = tally.schema["per_model_votes"].dataType.simpleString()
        listed = [F.coalesce("per_model_votes", F.array().cast(kind)).alias("per_model_votes")]
    return tally.select(
        sample_id(F.col("query_id"), F.col("docid")).alias("sample_id"),
        *PAIR,
        winner.alias("final_label"),
        confidence.alias("final_confidence"),
        F.struct(*[m.alias(name) for name, m in measures.items()]).alias("disagreement_metrics"),
        flags.alias("flags"),
        *listed,
        aggregation_strategy(strategy, default_weight, weights).alias("aggregation_strategy"),
    )


def aggregation_strategy(
    name: str, default_weight: float, weights: Mapping[str, float] | DataFrame | None
) -> Column:
    """Name and parameters of the strategy, carried on each row."""
    params = {"default_weight": str(float(default_weight))}
    if isinstance(weights, Mapping):
        params |= {f"weight.{k}": str(float(v)) for k, v in weights.items()}
    pairs = [F.lit(x) for item in params.items() for x in item]
    return F.struct(F.lit(name).alias("name"), F.create_map(*pairs).alias("params"))


def majority_vote(judgements: DataFrame, **options) -> DataFrame:
    """Every vote counts the same."""
    return vote(judgements, None, 1.0, strategy="majority", **options)


# Strategies by name: function judgements, **options -> ensemble.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"weighted_majority": vote, "majority": majority_vote}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    STRATEGIES[name] = strategy


def disagreement_sets(judgements: DataFrame) -> DataFrame:
    """Samples whose valid votes differ, with the models behind each label."""
    votes = one_vote(judgements).where(F.col("label").isNotNull())
    models = [
        F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("model_id")))).alias(f"models_{k}")
        for k in LABELS
    ]
    sets = votes.groupBy(*PAIR).agg(F.count_distinct("label").alias("n_distinct"), *models)
    return sets.where(F.col("n_distinct") > 1)


def disagreement_pairs(judgements: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Per pair of models: samples both labelled, and samples labelled differently.

    Models are those of the judgements, and those of `models` beside them, with zeros where
    they never meet. A sample's votes, one per model and so no more than the panel, pair up
    within the sample, and pairs are counted with map-side aggregation.
    """
    votes = one_vote(judgements).where(F.col("label").isNotNull())
    listed = votes.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("model_id", "label"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(
        F.slice("v", i + 2, F.size("v")),
        lambda b: F.struct(a["model_id"].alias("model_a"), b["model_id"].alias("model_b"),
                           F.lit(1).alias("both"), (a["label"] != b["label"]).cast("int").alias("different")))))
    met = listed.select(F.inline(pairs))
    ids = judgements.select("model_id").where(F.col("model_id").isNotNull()).distinct()
    if models is not None:
        named = F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id")
        ids = ids.union(judgements.sparkSession.range(1).select(named)).distinct()
    panel = ids.agg(F.sort_array(F.collect_set("model_id")).alias("m"))  # the panel
    every = panel.select(F.inline(F.flatten(F.transform("m", lambda a, i: F.transform(
        F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("model_a"), b.alias("model_b"),
                                                             F.lit(0).alias("both"), F.lit(0).alias("different")))))))
    return met.unionByName(every).groupBy("model_a", "model_b").agg(
        F.sum("both").alias("n_both"), F.sum("different").alias("n_different"))
