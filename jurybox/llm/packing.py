"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Only lengths matter to the packing, and there are no more of them than the capacity. Their
counts, at most `capacity` numbers whatever the input, are packed on the driver: longest
first, each into the open sequence with the least room that still holds it, which a
segment tree over the remaining room finds in logarithmic time. The result is a short list
of runs: so many pieces of one length, from one rank on, go to consecutive sequences at one
offset. Tasks look up each piece's rank in it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import give_back, settle
from jurybox.llm.tokens import chunks, encoder, with_end

CAPACITY = 2048


class RoomTree:
    """Segment tree over remaining room 0..capacity: whether a sequence with that room is open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that is open."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) and the number of sequences.

    The pieces of a run, by rank, go to consecutive sequences at the same offset.
    """
    tree, rooms, runs, used = RoomTree(capacity), defaultdict(list), [], 0

    def leave(room: int, first: int, n: int) -> None:
        rooms[room].append((first, n))
        tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = min(room // length, left)  # best fit goes on filling the sequence it began
            full = min(n, left // each)
            for k in range(each):
                runs.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            leave(room - each * length, first, full)
            if full < n:
                if room == capacity:  # the last, partly filled sequence of those just opened
                    for k in range(left):
                        runs.append((length, rank + k, 1, first + full, k * length))
                    leave(room - left * length, first + full, 1)
                    left = 0
                else:
                    leave(room, first + full, n - full)
    return runs, used


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for piece in chunks(batch, "text"):
                ids, bounds = with_end(*encoder(tokenizer).encode(piece.column("text")), end_id)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                # the rank among this task's pieces of the same length
                order = np.argsort(length, kind="stable")
                firsts = np.concatenate([[True], np.diff(length[order]) > 0])
                rank = np.empty(len(doc), dtype=np.int64)
                rank[order] = np.arange(len(doc)) - np.maximum.accumulate(np.where(firsts, np.arange(len(doc)), 0))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                at = np.concatenate([bounds[doc] + start, bounds[-1:]])
                data = ids.astype("<u4").tobytes()
                view = memoryview(data)
                crc = np.fromiter((zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])), dtype=np.int64, count=len(doc))
                blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * at).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                    blob, pa.array(crc), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(rank),
                ], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "rank"])
        give_back()

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids (little-endian unsigned 32 bit), their crc32.

    `part` and `rank` number the pieces of a length within the task that cut them; write the
    table before using them, so that a task run again cannot number them anew. Null and empty
    texts are the end id alone, so every row has a piece; repeated rows have pieces each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _cut(tokenizer, end_id, capacity),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, part int, rank bigint")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces; ids are not read unless asked for.

    Pieces of one length may be any share of all: their ranks come from counts per
    (length, part), so no task gathers them.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs, _ = plan({r["length"]: r["n"] for r in totals}, capacity)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)  # bounded by the capacity, not by the input
    shared = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = shared.value.T
        for batch in batches:
            ln = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            lo = np.searchsorted(length, ln, side="left")
            hi = np.searchsorted(length, ln, side="right")
            while (more := hi - lo > 1).any():  # binary search of the rank among the runs of its length
                mid = (lo + hi) // 2
                right = first[mid] <= rank
                lo, hi = np.where(more & right, mid, lo), np.where(more & ~right, mid, hi)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "rank"),
                 pa.array(sequence[lo] + rank - first[lo]), pa.array(offset[lo])],
                names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.select(*[f.name for f in kept], "rank").mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with `ids` if asked.

    An empty table gives no pieces. Columns other than id and text are not read.
    """
    pieces = settle(cut(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    return place(pieces if with_ids else pieces.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces with ids: at most `capacity` ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
