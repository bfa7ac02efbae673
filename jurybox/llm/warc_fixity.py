"""Fixity audit of WARC replicas with Merkle trees over records and ordered offset ranges.

A record's leaf is the SHA-256 of its stored bytes. A node hashes the offsets, lengths and
hashes of up to FANOUT children in order, first within a file, then over files. Replicas are
compared root first; only children of nodes that differ are read on the way down.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import settle
from jurybox.llm.tokens import chunks

FANOUT_BITS = 8
RECORD_BITS = 16  # records of a file
FILE_BITS = 16  # files of a task
FILE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
ARCHIVE = "file_no bigint, content binary, places array<bigint>, record_ids array<bigint>, offsets array<bigint>, lengths array<bigint>"


def warc_record(record_id: int | None, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    """One resource record as a gzip member; equal input gives equal bytes."""
    head = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>\r\n"
            f"WARC-Date: {date}\r\nWARC-Target-URI: {' '.join((url or '').split())}\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n")
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", compresslevel=4, mtime=0)


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one stored record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, size, data, ids, lengths = 0, 0, [], [], []
    part = TaskContext.get().partitionId()

    def file() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << FILE_BITS) + number], pa.int64()), pa.array([b"".join(data)], pa.binary()),
             *(pa.array([x], kind) for x in (list(range(len(ids))), ids, offsets.tolist(), lengths))],
            names=["file_no", "content", "places", "record_ids", "offsets", "lengths"])

    for batch in batches:
        for piece in chunks(batch, "html", FILE_BYTES):
            for record_id, url, page in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                record = warc_record(record_id, url, (page or "").encode())
                data.append(record)
                ids.append(record_id)
                lengths.append(len(record))
                size += len(record)
                if len(ids) == 1 << RECORD_BITS or size >= FILE_BYTES:
                    yield file()
                    number, size, data, ids, lengths = number + 1, 0, [], [], []
    if ids:
        yield file()


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Written table of WARC files: number, bytes, and the index of record ids, offsets and lengths.

    Null pages are empty payloads; every row is a record, repeated ones too. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return settle(rows.mapInArrow(_write, ARCHIVE), "warc", "none")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file_no, content, *index in zip(*(batch.column(c) for c in ("file_no", "content", "places", "record_ids", "offsets", "lengths"))):
            data = memoryview(content.as_buffer())
            places, ids, offsets, lengths = (x.as_py() for x in index)
            yield pa.RecordBatch.from_arrays([
                pa.array((file_no.as_py() << RECORD_BITS) + np.array(places, dtype=np.int64)), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array([hashlib.sha256(data[o:o + k]).hexdigest() for o, k in zip(offsets, lengths)], pa.string()),
            ], names=["node", "record_id", "start", "length", "hash"])


def build_tree(files: DataFrame) -> DataFrame:
    """Written table of all nodes: level, node, parent, start, length, hash, and record_id on level 0.

    A leaf is numbered by file and place in it; a parent by its children's numbers without
    their last FANOUT_BITS bits, so a node has at most 2^FANOUT_BITS children, whatever the
    input, and both replicas number the same place alike. The top level is one node.
    """
    leaves = settle(files.mapInArrow(_leaves, "node bigint, record_id bigint, start bigint, length bigint, hash string"), "leaves")
    top = leaves.agg(F.max("node")).first()[0] or 0
    level = leaves.select(F.lit(0).alias("level"), "node", "start", "length", "hash", "record_id")
    levels = [level]
    for depth in range(1, -(-max(int(top).bit_length(), 1) // FANOUT_BITS) + 1):
        child = F.struct("node", "start", "length", "hash")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(
            ":", c["node"].cast("string"), c["start"].cast("string"), c["length"].cast("string"), c["hash"])), "\n")
        level = level.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.min("start").alias("start"), F.sum("length").alias("length"), F.sha2(text, 256).alias("hash"))
        level = level.select(F.lit(depth).alias("level"), "node", "start", "length", "hash", F.lit(None).cast("bigint").alias("record_id"))
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return settle(out.withColumn("parent", F.shiftright("node", FANOUT_BITS)), "tree")


def audit(tree: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two trees: node, record_id, start, length, status.

    `corrupt`: same place, other bytes; `missing`: not in the replica; `extra`: only in the
    replica. From the root down, a level is joined with the differing nodes above it only.
    Equal trees, and two empty ones, give no rows; against an empty one every record differs.
    """
    depth = max(t.agg(F.max("level")).first()[0] or 0 for t in (tree, replica))
    differing = None
    for level in range(depth, -1, -1):
        a, b = (t.where(F.col("level") == level) for t in (tree, replica))
        if differing is not None:
            above = differing.select(F.col("node").alias("parent"))
            a, b = a.join(above, "parent", "left_semi"), b.join(above, "parent", "left_semi")
        a = a.select("node", F.struct("record_id", "start", "length", "hash").alias("a"))
        b = b.select("node", F.struct("record_id", "start", "length", "hash").alias("b"))
        differing = a.join(b, "node", "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))
                                                     | (F.col("a.start") != F.col("b.start")) | (F.col("a.length") != F.col("b.length")))
        if level and not differing.isEmpty():
            differing = settle(differing.select("node"), "differing")
        elif level:
            return _report(differing.limit(0))
    return _report(differing)


def _report(differing: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    status = F.when(b.isNull(), "missing").when(a.isNull(), "extra").otherwise("corrupt")
    pick = lambda c: F.coalesce(a[c], b[c]).alias(c)
    return differing.select("node", pick("record_id"), pick("start"), pick("length"), status.alias("status"))


def decay(files: DataFrame, flips: int, losses: int) -> DataFrame:
    """A replica as a failing disk would leave it, by rule: records whose id leaves 5 modulo `flips` have one byte
    changed, and those that leave 3 modulo `losses` are gone from the index. For trying the audit on real archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = bytearray(row["content"])
                kept = []
                for i, (record_id, start, size) in enumerate(zip(row["record_ids"], row["offsets"], row["lengths"])):
                    if record_id is not None and record_id % losses == 3:
                        continue
                    if record_id is not None and record_id % flips == 5:
                        data[start + size // 2] ^= 0x20
                    kept.append(i)
                index = ("places", "record_ids", "offsets", "lengths")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file_no"]], pa.int64()), pa.array([bytes(data)], pa.binary()),
                     *(pa.array([[row[c][i] for i in kept]], pa.list_(pa.int64())) for c in index)],
                    names=["file_no", "content", *index])

    return files.mapInArrow(run, ARCHIVE)
