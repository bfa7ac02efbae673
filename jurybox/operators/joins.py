"""Joins against a table with a unique key, safe for hot keys on the other side.

All joins of the pipeline are lookups: qrels into queries and documents,
requests into completions and cached judgements, gold rows into the ensemble.
A small lookup table is left to Spark, which broadcasts it. For a large one the
rows of hot keys are spread over several tasks and only the few lookup rows of
those keys are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than 1/HOT_SHARE of all rows, so there are fewer
# than HOT_SHARE hot keys however large the input is; that bounds the broadcast
# of hot keys and the number of repeated lookup rows (at most 2 * HOT_SHARE).
HOT_SHARE = 1000
# Counters of the sketch that finds them: its error is 3.5 / HOT_TRACKED of the rows, far below a share.
HOT_TRACKED = 16_384
# A key is left whole while what the join makes of it, its rows with the lookup row's bytes, stays below this.
HOT_BYTES = 8 << 20
ROW_BYTES = 100  # of a lookup row where the caller names no other size


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimizer expects; a huge number where it has no statistics."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate lets it broadcast `df` without a hint."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) <= int(conf.autoBroadcastJoinThreshold())


def key_hash(on: Sequence[str]) -> Column:
    """A key as one number. Keys that share it are spread together, which costs copies but changes no result."""
    return F.xxhash64(*on)


def hot_keys(
    df: DataFrame, on: Sequence[str], share: int | None = None, min_rows: int | None = None, row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """(_hot, _parts): hashes of the keys with more than 1/share of the rows, and the number of parts to make.

    One pass over the keys: a sketch of frequent items, merged from one of fixed size per task, gives the
    keys and their counts; no key is shuffled. Keys of fewer than `min_rows` rows (default: HOT_BYTES over
    `row_bytes`) stay whole.
    """
    share = share or HOT_SHARE
    min_rows = max(1, HOT_BYTES // row_bytes) if min_rows is None else min_rows
    keys = df.select(key_hash(on).alias("_h"))
    found = keys.agg(F.count(F.lit(1)).alias("_total"), F.expr(f"approx_top_k(_h, {share}, {max(HOT_TRACKED, 16 * share)})").alias("_top"))
    each = found.select("_total", F.inline("_top"))
    parts = F.least(F.lit(share), F.greatest(F.lit(2), F.ceil(F.col("count") * share / F.col("_total")))).cast("int")
    return each.where((F.col("count") > F.col("_total") / share) & (F.col("count") > min_rows)).select(
        F.col("item").alias("_hot"), parts.alias("_parts"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    share: int | None = None,
    min_rows: int | None = None,
    salted: bool | None = None,
    hot: DataFrame | None = None,
    hot_on: Sequence[str] | None = None,
    row_bytes: int = ROW_BYTES,
    greatest: str | None = None,
) -> DataFrame:
    """Join `left` to `right`, whose key `on` is unique.

    `how` is inner, left, left_semi or left_anti. Rows of a hot key are spread
    by a hash of `spread_by` (default: all columns of `left`), a value of the
    row itself, so a task run again after a lost executor makes the same split.
    Rows equal in all `spread_by` columns stay together: give a column that is
    unique per row, such as line_no. `hot` is the result of `hot_keys` where the
    caller has it, over the columns `hot_on` (default: `on`); any bounded set of keys
    keeps the result right. `row_bytes` is about the size of a lookup row. Where keys of `right` may repeat
    all the same, `greatest` names the column by which `last_wins` takes one row, in the exchange of a spread join.
    """
    on = [on] if isinstance(on, str) else list(on)
    if salted is None:
        salted = not fits_broadcast(right)
    if not salted:
        return left.join(last_wins(right, on, greatest) if greatest else right, on, how)

    hot = F.broadcast(hot_keys(left, on, share, min_rows, row_bytes) if hot is None else hot)

    def with_parts(df: DataFrame) -> DataFrame:
        # By hash, which null keys of an outer join have as well.
        return df.join(hot, key_hash(hot_on or on) == F.col("_hot"), "left").select(*df.columns, "_parts")

    spread = F.xxhash64(*(spread_by or left.columns))
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(spread, F.col("_parts").cast("bigint")).cast("int")
    )
    left_parts = with_parts(left).withColumn("_salt", salt).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    right_parts = with_parts(right).withColumn("_salt", F.explode(copies)).drop("_parts")
    if greatest:
        right_parts = last_wins(right_parts, [*on, "_salt"], greatest)
    return left_parts.join(right_parts, [*on, "_salt"], how).drop("_salt")


def last_wins(df: DataFrame, key: str | Sequence[str], order: str = "line_no") -> DataFrame:
    """One row per key, the one with the highest `order`; a null key is a key as well.

    A null order loses to any other. Rows of one key and order are told apart by their other columns,
    the greatest in the order of the columns stays, nulls last: the result is the same however rows are
    spread, and rows equal in every column are one. A maximum over (order, columns) that combines on
    the map side, so the input is read once and copies of a hot key cost one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [order, *[c for c in df.columns if c not in (*keys, order)]]
    last = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])
