"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jurybox.operators.joins import estimated_bytes

# The table of splits has one row of about 100 bytes per file split; up to this
# many rows it is broadcast (about 200 MB), beyond it Spark shuffles.
MAX_BROADCAST_SPLITS = 2_000_000
# Files whose line counts are summed up in one window.
FILES_AT_ONCE = 1024


def _expected_splits(spark: SparkSession, text: DataFrame) -> int:
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return len(text.inputFiles()) + estimated_bytes(text) // max(int(limit), 1)


def _upto(sums: str, *within: str, order: str) -> Column:
    """The running sum before a row, inside `within`."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(sums).over(before), F.lit(0))


def _bases(splits: DataFrame, cuts: list[str]) -> DataFrame:
    """Splits with `_base`, the lines before each: summed up inside its file, its group of files, and over groups.

    Files are grouped at the paths `cuts`, which are in order. A window holds the splits of a file or the
    files of a group; of the groups, one per FILES_AT_ONCE files, one short list is kept.
    """
    group = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: c <= F.col("_path"))).alias("_group")
    files = splits.groupBy("_path").agg(F.sum("_n").alias("_lines")).select("*", group)
    listed = files.groupBy("_group").agg(F.sum("_lines").alias("_lines")).agg(
        F.array_sort(F.collect_list(F.struct("_group", "_lines"))).alias("_all"))
    total = F.transform("_all", lambda g, i: F.struct(
        g["_group"].alias("_group"), F.aggregate(F.slice("_all", 1, i), F.lit(0).cast("bigint"), lambda a, b: a + b["_lines"]).alias("_earlier")))
    placed = files.withColumn("_inside", _upto("_lines", "_group", order="_path")).join(F.broadcast(listed.select(F.inline(total))), "_group")
    of_file = placed.select("_path", (F.col("_earlier") + F.col("_inside")).alias("_of_file"))
    in_file = splits.withColumn("_in_file", _upto("_n", "_path", order="_start"))
    return in_file.join(of_file, "_path").select("_path", "_start", "_first", "_last", (F.col("_of_file") + F.col("_in_file")).alias("_base"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no BIGINT, value STRING); numbers start at 1 and count blank lines.

    Lines are numbered through all files in the order of their paths. The text
    itself is never shuffled: a first pass counts the lines of each split, the
    counts are summed up by levels in file order, and each line adds its place within its
    split. Both passes must see the same splits; a row that falls outside its
    split's range stops the job instead of getting a wrong number.
    """
    text = spark.read.text(path)
    raw = text.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    splits = raw.groupBy("_path", "_start").agg(
        F.min("_seq").alias("_first"), F.max("_seq").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    base = _bases(splits, sorted(text.inputFiles())[FILES_AT_ONCE::FILES_AT_ONCE])
    if _expected_splits(spark, text) <= MAX_BROADCAST_SPLITS:
        base = F.broadcast(base)
    inside = F.col("_seq").between(F.col("_first"), F.col("_last"))
    line_no = F.when(inside, F.col("_base") + F.col("_seq") - F.col("_first") + 1).otherwise(
        F.raise_error(F.lit("file splits changed between the two passes of read_lines")).cast("bigint")
    )
    return raw.join(base, ["_path", "_start"], "left").select(line_no.alias("line_no"), "value")
