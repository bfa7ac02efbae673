"""Earlier answers as a bucketed table, with a Bloom filter over their prompts.

The table is bucketed by the prompt's hash, so a join by it moves no stored row. The filter is a
bounded number of bits; a prompt it does not know has no stored answer for certain, and its text
need not meet the table at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "prompt_sha256"
BUCKETS = 64
# Bits of the filter: 16 per prompt, a power of two, at most 64 MB; beyond that it prunes less and stays right.
MIN_BITS, MAX_BITS, BITS_PER_PROMPT = 1 << 16, 1 << 29, 16
HASHES = 4


def answered(judged: DataFrame) -> DataFrame:
    """The rows of an earlier judgements table that hold an answer; a table of keys alone lists answered ones."""
    return judged if "raw_text" not in judged.columns else judged.where(F.col("raw_text").isNotNull())


def write_cache(judged: DataFrame, table: str, buckets: int = BUCKETS, mode: str = "overwrite") -> str:
    """Store the answered rows as `table`, bucketed and sorted by prompt; `mode` append adds a run's rows to it."""
    rows = answered(judged).where(F.col(KEY).isNotNull()).repartition(buckets, KEY)  # one file per bucket
    rows.write.mode(mode).format("parquet").bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table)
    _write_filter(judged.sparkSession, table)
    return table


def read_cache(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def _positions(bits: int) -> Column:
    """Where a prompt stands in a filter of so many bits: pieces of 32 bits of its hash."""
    pieces = [F.conv(F.substring(KEY, 1 + 8 * i, 8), 16, 10).cast("bigint") % bits for i in range(HASHES)]
    return F.array(*pieces)


def _write_filter(spark: SparkSession, table: str) -> None:
    """`<table>_prompts`: the filter's words that are not zero, or-ed on the map side."""
    stored = spark.table(table).select(KEY)
    wanted = max(MIN_BITS, BITS_PER_PROMPT * (stored.agg(F.approx_count_distinct(KEY)).first()[0] or 0))
    bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())
    at = stored.select(F.explode(_positions(bits)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("bigint").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    words.withColumn("bits", F.lit(bits)).write.mode("overwrite").format("parquet").saveAsTable(f"{table}_prompts")


def may_be_stored(spark: SparkSession, table: str) -> Column:
    """Whether a row's `prompt_sha256` can have an answer in `table`; false means it has none for certain."""
    rows = spark.table(f"{table}_prompts").toPandas()  # at most MAX_BITS / 64 words by construction
    if rows.empty:
        return F.lit(False)
    bits = int(rows["bits"].iloc[0])
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["value"].to_numpy()
    shared = spark.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf("boolean")
    def known(prompt: pd.Series) -> pd.Series:
        text = prompt.fillna("")
        hit = (text.str.len() == 64).to_numpy()
        numbers = text.where(hit, "0" * 64)
        for i in range(HASHES):
            at = np.array([int(s[8 * i:8 * i + 8], 16) for s in numbers], np.int64) % bits
            hit &= (shared.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(hit)

    return known(F.col(KEY))
