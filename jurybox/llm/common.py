"""Helpers the operators share: scratch tables, private column names, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names.

    `spark.checkpoint.dir` is read from the session. Only where it is unset and Spark runs on
    one machine, as in tests, is a temporary folder taken and put there; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="jurybox-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluated(df: DataFrame) -> DataFrame:
    """The same rows out of a generator: a filter on a computed column is not pushed below it and computed again."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def give_back() -> None:
    """Return freed memory of numpy and Arrow to the system: idle Python workers then hold little of it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a glibc system
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(text: str | Column) -> Column:
    """A fingerprint that, beside the id, tells documents with the same id apart; null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def words_of(text: Column) -> Column:
    """Runs without white space (space, tab to carriage return), in order; null text has none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(flat, " ", -1), "")
