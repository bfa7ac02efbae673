"""Evaluate operators: gold join, confusion, accuracy, macro F1, slices, calibration.

Rows to score have columns `gold`, `pred` and optionally `n`, the number of
equal rows they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.operators.joins import lookup_join

PAIR = ["query_id", "docid"]


def join_gold(ensemble: DataFrame, samples: DataFrame) -> DataFrame:
    """Decisions with their gold label; `n` counts the qrels behind the row.

    Qrels are counted per pair and gold label first, so the join has few rows
    per key on either side.
    """
    gold = samples.groupBy(*PAIR, F.col("gold_relevance").alias("gold")).agg(F.count(F.lit(1)).alias("n"))
    decided = ensemble.select(
        *PAIR, F.col("final_label").alias("pred"), F.col("final_confidence").alias("confidence"),
        *[c for c in ensemble.columns if c not in (*PAIR, "sample_id", "final_label", "final_confidence")],
    )
    return gold.join(decided, PAIR)


def judgement_scores(judgements: DataFrame, samples: DataFrame) -> DataFrame:
    """The same for each model's own judgements, one vote per model and pair."""
    from jurybox.operators.votes import one_vote

    gold = samples.groupBy(*PAIR, F.col("gold_relevance").alias("gold")).agg(F.count(F.lit(1)).alias("n"))
    return gold.join(one_vote(judgements).withColumnRenamed("label", "pred"), PAIR)


def length_bucket(text: Column) -> Column:
    """Slice of a document by length in characters."""
    n = F.length(text)
    return F.when(n < 1_000, F.lit("short")).when(n < 10_000, F.lit("medium")).otherwise(F.lit("long"))


def _n(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.lit(1)


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(gold, pred, n); a missing prediction is the row with pred null."""
    return df.groupBy(*by, "gold", "pred").agg(F.sum(_n(df)).cast("bigint").alias("n"))


def confusion_wide(df: DataFrame, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row per gold label, one column per prediction and one for none."""
    n = _n(df)
    return df.groupBy("gold").agg(
        *[F.sum(F.when(F.col("pred") == k, n).otherwise(0)).cast("bigint").alias(f"pred_{k}") for k in labels],
        F.sum(F.when(F.col("pred").isNull(), n).otherwise(0)).cast("bigint").alias("pred_null"),
    )


def classification_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy (no prediction is wrong) and macro F1 over labels that occur.

    Everything after the confusion counts works on a handful of rows per group.
    """
    by = list(by)
    counts = confusion_matrix(df, by)
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").cast("bigint").alias("label"), hit.alias("tp"), (F.col("n") - hit).alias("fn"), F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("rows")),
        F.struct(F.col("pred").cast("bigint").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"), (F.col("n") - hit).alias("fp"), F.lit(0).cast("bigint").alias("rows")),
    )
    per_label = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "rows")])
    )
    f1 = F.when(F.col("label").isNotNull(), 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return per_label.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        (F.sum("tp") / F.sum("rows")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
    )


def metrics_table(df: DataFrame) -> DataFrame:
    """The `metrics` row: accuracy, macro F1 and the confusion matrix as an array."""
    cells = confusion_matrix(df).agg(F.array_sort(F.collect_list(F.struct("gold", "pred", "n"))).alias("confusion_matrix"))
    return classification_metrics(df).drop("n").withColumn("_k", F.lit(0)).join(
        F.broadcast(cells.withColumn("_k", F.lit(0))), "_k"
    ).drop("_k")


def error_slices(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(slice, value, n, accuracy, macro_f1) for each slicing column on its own."""
    slices = F.array(
        *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by]
    )
    rows = df.select("gold", "pred", _n(df).alias("n"), F.inline(slices))
    return classification_metrics(rows, ["slice", "value"])


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence: rows, mean confidence, accuracy."""
    n = _n(df)
    bin_no = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    correct = F.when(F.col("gold") == F.col("pred"), n).otherwise(0)
    return (
        df.where(F.col("confidence").isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(
            F.sum(n).cast("bigint").alias("n"),
            (F.sum(F.col("confidence") * n) / F.sum(n)).alias("mean_confidence"),
            (F.sum(correct) / F.sum(n)).alias("accuracy"),
        )
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def confidence_table(df: DataFrame, digits: int | None = None) -> DataFrame:
    """(confidence, n, accuracy) per confidence; rounded to `digits` only if asked."""
    return _right(df, digits).select("confidence", "n", (F.col("right") / F.col("n")).alias("accuracy"))


def _right(df: DataFrame, digits: int | None) -> DataFrame:
    """(confidence, n, right): rows, and those with the right label, per confidence."""
    n = _n(df)
    correct = F.when(F.col("gold") == F.col("pred"), n).otherwise(0)
    return (
        df.where(F.col("confidence").isNotNull())
        .groupBy((F.col("confidence") if digits is None else F.round("confidence", digits)).cast("double").alias("confidence"))
        .agg(F.sum(n).cast("bigint").alias("n"), F.sum(correct).cast("bigint").alias("right"))
    )


# Block lists that one task of the next level merges.
FAN = 64
# Blocks that are looked up together: their first confidences alone come to the driver.
CHUNK = 64

BLOCKS = "part bigint, seq bigint, low double, high double, n bigint, right bigint"


def pool(blocks: Iterator[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Adjacent blocks (low, high, n, right) in order, pooled until their shares of right rows increase.

    Shares are compared as whole numbers, so the order of merging does not matter: pooling lists that
    were pooled before gives what one pass over everything gives.
    """
    out: list[tuple[float, float, int, int]] = []
    for low, high, n, right in blocks:
        while out and out[-1][3] * n >= right * out[-1][2]:
            low, _, more, more_right = out.pop()
            n, right = n + more, right + more_right
        out.append((low, high, n, right))
    return out


def _pool_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`pool` for the blocks of each part, which come sorted by part and place."""
    names = ["low", "high", "n", "right"]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ["part", *names]])

    def result(part: int, blocks: list) -> pa.RecordBatch:
        size = len(blocks)
        columns = [pa.array([b[i] for b in blocks], pa.float64() if i < 2 else pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int64()), pa.array(range(size), pa.int64()), *columns], ["part", "seq", *names])

    stream = rows()
    row = next(stream, None)
    while row is not None:
        part = row[0]

        def of_part() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == part:
                yield row[1:]
                row = next(stream, None)

        yield result(part, pool(of_part()))


def fit_calibration(df: DataFrame, digits: int | None = None, fan: int = FAN) -> DataFrame:
    """Isotonic regression of being right on confidence: blocks (seq, low, high, n, right, calibrated) in order.

    Rows of equal confidence are counted first. Each range of confidences is pooled by itself, and the
    lists of `fan` adjacent ranges are merged and pooled again, level by level, in their order. Only blocks
    move on: with whole numbers of rows, N rows allow about N^(2/3) blocks of increasing shares at most,
    and noisy labels leave about the cube root. The few blocks are kept in Spark's cache, since `calibrate`
    reads them twice; `unpersist()` frees them. `digits` rounds confidences before; it moves thresholds.
    """
    spark = df.sparkSession
    points = _right(df, digits).select(F.col("confidence").alias("low"), F.col("confidence").alias("high"), "n", "right")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(parts, "low").withColumn("part", F.spark_partition_id().cast("bigint"))
    blocks = ranged.sortWithinPartitions("part", "low").withColumn("seq", F.lit(0).cast("bigint")).select(
        "part", "seq", "low", "high", "n", "right").mapInArrow(_pool_parts, BLOCKS)
    while parts > 1:
        parts = -(-parts // fan)
        merged = blocks.withColumn("group", F.expr(f"part div {fan}"))
        placed = merged.repartition(parts, "group") if parts > 1 else merged.repartition(1)
        blocks = placed.sortWithinPartitions("group", "part", "seq").drop("part").withColumnRenamed("group", "part").mapInArrow(
            _pool_parts, BLOCKS)
    return blocks.select("seq", "low", "high", "n", "right", (F.col("right") / F.col("n")).alias("calibrated")).persist()


def calibrate(blocks: DataFrame, df: DataFrame) -> DataFrame:
    """Add `calibrated`, the fitted chance of being right, to rows with a `confidence`.

    Inside a block it is the block's share, between two blocks on the line between them, outside that of
    the nearest. Null where the confidence is null or nothing was fitted. Blocks are looked up CHUNK at
    a time: a confidence finds its chunk by the chunks' first confidences, one number per CHUNK blocks.
    """
    after = F.struct(F.col("seq").alias("seq"), F.col("low").alias("low"), F.col("high").alias("high"), F.col("calibrated").alias("share"))
    # Each chunk also holds the block after its last.
    member = blocks.select(after.alias("b"), F.explode(F.array_distinct(F.array(
        F.expr(f"seq div {CHUNK}"), F.greatest(F.expr(f"(seq - 1) div {CHUNK}"), F.lit(0).cast("bigint"))))).alias("_chunk"))
    chunks = member.groupBy("_chunk").agg(F.array_sort(F.collect_list("b")).alias("_blocks"))
    firsts = np.array([r["low"] for r in blocks.where(F.col("seq") % CHUNK == 0).select("seq", "low").orderBy("seq").collect()], dtype=float)

    @F.pandas_udf("bigint")
    def chunk_of(confidence: pd.Series) -> pd.Series:
        place = np.searchsorted(firsts, confidence.to_numpy(dtype=float), side="right") - 1
        return pd.Series(np.maximum(place, 0)).astype("Int64").where(confidence.notna().to_numpy(), None)

    x = F.col("confidence").cast("double")
    placed = df.withColumn("_chunk", chunk_of(x))
    found = lookup_join(placed, chunks, "_chunk", "left")
    before = F.element_at(F.filter("_blocks", lambda b: b["low"] <= x), -1)
    behind = F.element_at(F.filter("_blocks", lambda b: b["low"] > x), 1)
    rows = found.withColumns({"_before": F.when(F.size(F.filter("_blocks", lambda b: b["low"] <= x)) > 0, before),
                              "_behind": F.when(F.size(F.filter("_blocks", lambda b: b["low"] > x)) > 0, behind)})
    left, right = F.col("_before"), F.col("_behind")
    line = left["share"] + (right["share"] - left["share"]) * (x - left["high"]) / (right["low"] - left["high"])
    value = F.when(left.isNull(), right["share"]).when((x <= left["high"]) | right.isNull(), left["share"]).otherwise(line)
    return rows.withColumn("calibrated", F.when(x.isNotNull(), value)).select(*df.columns, "calibrated")
