"""Token ids in Parquet: list columns, dictionary or delta encoded, with page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.llm.common import give_back
from jurybox.llm.tokens import chunks, encoder, with_end

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
# Ids repeat, so a dictionary packs them in 16 bits; the other columns ascend or are
# narrow and are delta encoded, which needs Parquet's version 2 pages.
LAYOUT = {
    "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}
MAX_BROADCAST_PARTS = 100_000


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in chunks(batch, "text"):
                ids, bounds = with_end(*encoder(tokenizer).encode(piece.column("text")), end_id)
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(before + bounds[:-1]),
                    pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                before += int(bounds[-1])
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write each document's ids, `end_id` last, to Parquet at `path` in ascending id order.

    Files follow each other in id order, rows within a file too; null ids come first, and
    documents that share an id stand in the order of their texts. Null and empty texts have
    the end id alone. An empty table writes no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = ranged.mapInArrow(
        _encode(tokenizer, end_id), f"doc_id {kind}, part int, part_start bigint, n_tokens bigint, ids array<int>")
    encoded.write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, and start: how many ids all documents before it have. No ids are read."""
    return _placed(spark, spark.read.parquet(path).drop("ids"), path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids. A filter on doc_id skips row groups and pages by their indexes."""
    return _placed(spark, spark.read.parquet(path), path)


def _placed(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file: the window's single task and the broadcast hold as many rows as there are files.
    before = parts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")
    if parts.count() <= MAX_BROADCAST_PARTS:
        before = F.broadcast(before)
    joined = rows.join(before, "part")
    ids = ["ids"] if "ids" in rows.columns else []
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", *ids)


def checksums(rows: DataFrame) -> DataFrame:
    """`ids` replaced by the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            at = lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "ids"), pa.array(crc)],
                names=[*(c for c in batch.schema.names if c != "ids"), "ids_crc32"])

    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept], "ids").mapInArrow(run, f"{schema}, ids_crc32 bigint")
