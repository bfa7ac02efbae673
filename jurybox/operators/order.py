"""Exact order statistics without collecting a column into one task: radix selection on counts.

A value becomes a 64-bit key of the same order. Keys are counted by their first 16 bits; the
counts tell in which of the at most 65,536 cells a wanted rank lies, and the values of that cell are
counted by the next 16 bits. After four digits a cell is one value, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many rows of a limit, with their texts, come to one task; beyond it a cut by rank is used.
ONE_TASK_ROWS = 1_000
DIGIT = 16
DIGITS = 4


def smallest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the smallest values of `column`, whose values are unique; a negative n leaves out the last |n|.

    No count is taken while the plan is built: the cut is a scalar subquery over the column's values alone.
    """
    if 0 <= n <= ONE_TASK_ROWS:
        return df.orderBy(column).limit(n)
    wanted = F.least(F.lit(n), F.col("_total")) if n > 0 else F.col("_total") + n
    cut = order_statistics(df.select(column), column, {"v": wanted - 1})
    return df.where(F.col(column) <= cut.select(F.col("v").cast("bigint")).scalar())


def ordered_key(value: Column, kind: T.DataType) -> Column:
    """A BIGINT that orders like `value`: integers themselves, of doubles their bits, those of negative ones turned over."""
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def order_statistics(
    df: DataFrame, value: str, ranks: dict[str, Column], by: Sequence[str] = (),
) -> DataFrame:
    """Values at the given ranks per group, one column per name in `ranks`.

    A rank is an expression over `_total`, the group's number of non-null values, counted from zero;
    one outside 0 to `_total` - 1 finds null. Equal values become one row with a count first, combined on
    the map side; all digits read these counts from the same shuffle. A window holds the cells of one
    digit, at most 65,536 rows.
    """
    kind = df.schema[value].dataType
    stored = F.col(value) if isinstance(kind, T.IntegralType) else F.col(value).cast("double")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(_group(by), stored.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_g", "_v", "_n", ordered_key(F.col("_v"), kind).alias("_key"))
    )

    def cells(rows: DataFrame, digit: int, *more: Column) -> DataFrame:
        here = F.shiftright("_key", 64 - DIGIT * (digit + 1))
        # The first digit keeps its sign, which orders it.
        cell = (here if digit == 0 else here.bitwiseAND((1 << DIGIT) - 1)).alias("_cell")
        prefix = ["_g", "_p"] if digit else ["_g"]
        return rows.groupBy(*prefix, cell).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"), *more)

    wanted = F.array(*[F.struct(F.lit(k).alias("_name"), r.cast("bigint").alias("_rank")) for k, r in ranks.items()])
    first = cells(counts, 0).withColumn("_total", F.sum("_n").over(Window.partitionBy("_g"))).withColumn("_ranks", wanted)
    found = _pick(first, ["_g"]).select("_g", F.col("_cell").alias("_p"), "_v", "_ranks")
    for digit in range(1, DIGITS):
        # At most as many rows per group as ranks: Spark sees their size at run time and broadcasts them if
        # they are few, else it splits hot prefixes of the counts.
        narrowed = counts.withColumn("_p", F.shiftright("_key", 64 - DIGIT * digit)).join(found.select("_g", "_p", "_ranks"), ["_g", "_p"])
        picked = _pick(cells(narrowed, digit, F.any_value("_ranks").alias("_ranks")), ["_g", "_p"])
        longer = F.shiftleft("_p", DIGIT).bitwiseOR(F.col("_cell"))
        found = picked.select("_g", longer.alias("_p"), "_v", "_ranks")
    named = found.select("_g", "_v", F.inline("_ranks"))
    at = [F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks]
    return named.groupBy("_g").agg(*at).select(*[F.col(f"_g.{b}").alias(b) for b in by], *ranks)


def _group(by: Sequence[str]) -> Column:
    """The grouping columns as one never-null key."""
    return F.struct(*by).alias("_g") if by else F.struct(F.lit(0).alias("all")).alias("_g")


def _pick(cells: DataFrame, within: Sequence[str]) -> DataFrame:
    """Cells at which the running count passes a rank; these ranks, relative to the cell."""
    running = Window.partitionBy(*within).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    passed = cells.withColumn("_upto", F.sum("_n").over(running)).withColumn("_before", F.col("_upto") - F.col("_n"))
    here = F.transform(
        F.filter("_ranks", lambda r: (r["_rank"] >= F.col("_before")) & (r["_rank"] < F.col("_upto"))),
        lambda r: F.struct(r["_name"].alias("_name"), (r["_rank"] - F.col("_before")).alias("_rank")),
    )
    return passed.withColumn("_ranks", here).where(F.size("_ranks") > 0)


def percentiles(
    df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (), extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact percentiles with linear interpolation per group, named by `points`.

    `extra` are further aggregates to compute per group in the same pass.
    """
    by = list(by)
    extra_names = df.groupBy(*by).agg(F.count(F.lit(1)), *extra).columns[len(by) + 1:]
    last = F.col("_total") - 1
    ranks: dict[str, Column] = {}
    for k, p in points.items():
        ranks[f"_l_{k}"] = F.floor(last * p)
        ranks[f"_h_{k}"] = F.ceil(last * p)
    values = order_statistics(df, value, ranks, by)
    if by:
        totals = df.groupBy(_group(by)).agg(*extra, (F.count(value) - 1).alias("_last"))
        found = values.select(_group(by), *[c for c in values.columns if c not in by])
        joined = totals.join(found, "_g", "left")
    else:  # one row, also of no rows: the values found are looked up by a scalar subquery
        totals = df.agg(*extra, (F.count(value) - 1).alias("_last"))
        joined = totals.withColumn("_found", values.select(F.struct(*ranks)).scalar()).select("*", "_found.*")

    def point(k: str, p: float) -> Column:
        # The same steps as Spark's `percentile`, so that both forms agree to the last bit.
        place = F.col("_last") * F.lit(p)
        low, high = F.col(f"_l_{k}"), F.col(f"_h_{k}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when((F.ceil(place) == F.floor(place)) | (low == high), low).otherwise(between).alias(k)

    return joined.select(
        *[F.col(f"_g.{b}").alias(b) for b in by], *extra_names, *[point(k, p) for k, p in points.items()]
    )
