"""Repeated byte strings across documents, by an enhanced suffix array over candidate regions.

1. Copies of a whole text are one class; only its first document goes on.
2. Every window of `length` bytes has an anchor: its first least hash of K bytes. Equal
   windows have equal anchors at equal places, so only windows whose anchor occurs twice can
   repeat. Tasks send anchors as blobs by hash range; repeated ones go back to their documents.
3. The text around each repeated anchor (the windows it owns) goes to the anchor's group.
   There the suffixes at window starts are sorted; equal 100-byte prefixes are intervals of the
   suffix array. Intervals whose occurrences all follow the same byte are
   part of a longer repeat further left and are left out. A stack scan of the common prefix
   lengths of the others gives the interval tree: maximal repeats with all their occurrences.
4. All occurrences but the first (least document, then least start) are removed.

Anchors with over HOT occurrences are not grouped: their windows are counted by content with
map-side minima, which needs no group at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import give_back, settle, text_key
from jurybox.llm.tokens import chunks, spread

LENGTH = 100
K = 32
CHUNK_BYTES = 2 << 20
BUCKET_ANCHORS = 250_000
BUCKET_BYTES = 2 << 20  # context bytes of a group, on average
HOT = 50_000


def byte_data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and their bounds."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, bounds - bounds[0]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on; K is a power of two."""
    mul = 0x9E3779B97F4A7C15
    table = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h, step = table[data], 1
    while step < K:
        h = h[:-step] * np.uint64(pow(mul, step, 1 << 64)) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """hash, place, first and last window start of every anchor; windows never leave their text."""
    span = length - K + 1
    starts = np.maximum(bounds[1:] - length + 1 - bounds[:-1], 0)
    windows = spread(bounds[:-1], starts)
    if not len(windows):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    h = _gram_hashes(data)
    # first least hash of each window: minima of hash and place over blocks of `span`
    n = len(h)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)[:n]
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    least = np.minimum(right[windows], left[windows + span - 1])
    # places where the hash equals the least, carried to the left: the first such place from each window start
    change = np.ones(len(windows), dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)
    firsts = np.flatnonzero(change)
    runs = np.diff(np.append(firsts, len(windows)))
    out_h, out_p, out_lo, out_hi = [], [], [], []
    lo, value = windows[firsts], least[firsts]
    hi = lo + runs - 1
    # within a run the least is the same; its first place may still move on when it is passed
    while len(lo):
        reach = np.minimum(span, n - lo)
        place = _first_equal(h, lo, value, reach)
        last = np.minimum(hi, place)
        out_h.append(value)
        out_p.append(place)
        out_lo.append(lo)
        out_hi.append(last)
        more = last < hi
        lo, hi, value = last[more] + 1, hi[more], value[more]
    return tuple(np.concatenate(x) for x in (out_h, out_p, out_lo, out_hi))


def _first_equal(h: np.ndarray, lo: np.ndarray, value: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """First place from lo on whose hash is `value`."""
    place, open_ = lo.copy(), np.arange(len(lo))
    while len(open_):
        wrong = h[place[open_]] != value[open_]
        open_ = open_[wrong]
        place[open_] += 1
    return place


def _anchor_blobs(buckets: int, length: int):
    from jurybox.llm.jaccard_join import _pack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                key = part.column("key").to_numpy(zero_copy_only=False)
                _, first = np.unique(key, return_index=True)  # copies within the chunk once
                part = part.take(pa.array(np.sort(first)))
                key = part.column("key").to_numpy(zero_copy_only=False)
                data, bounds = byte_data(part.column("text"))
                h, place, _, _ = anchors(data, bounds, length)
                doc = np.searchsorted(bounds, place, side="right") - 1
                place = place - bounds[doc]
                h = h >> np.uint64(16)
                order = np.argsort(h)
                h, doc, place = h[order], doc[order], place[order]
                bucket = (h * np.uint64(buckets) >> np.uint64(48)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    docs, at = np.unique(doc[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), key[docs].tobytes(), at.astype(np.uint32).tobytes(),
                                 place[a:b].astype(np.uint32).tobytes(), _pack(h[a:b])))
                if rows:
                    kinds = [pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["bucket", "key", "at", "place", "h"])
        give_back()

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Group of one hash range: per text key, the places of anchors that occur twice, and how often."""
    from jurybox.llm.jaccard_join import _unpack

    keys, place, h = [], [], []
    for i in range(group.num_rows):
        row = {c: group.column(c)[i].as_py() for c in ("key", "at", "place", "h")}
        key = np.frombuffer(row["key"], dtype=np.int64)
        keys.append(key[np.frombuffer(row["at"], dtype=np.uint32)])
        place.append(np.frombuffer(row["place"], dtype=np.uint32))
        h.append(_unpack(row["h"]))
    del group
    keys, place, h = map(np.concatenate, (keys, place, h))
    order = np.lexsort((place, keys, h))
    keys, place, h = keys[order], place[order], h[order]
    del order
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
    keys, place, h = keys[new], place[new], h[new]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    times = np.repeat(size, size)
    often = times > 1
    keys, place, times = keys[often], place[often], times[often]
    order = np.lexsort((place, keys))
    keys, place, times = keys[order], place[order], times[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = np.append(edges[1:], len(keys)) if len(edges) else edges
    hot = (times > HOT).astype(np.uint8)
    give_back()
    return pa.table({
        "key": pa.array(keys[edges]),
        "place": pa.array([place[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary()),
        "hot": pa.array([hot[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())})


CONTEXT = "anchor bigint, doc_id bigint, key bigint, at bigint, own int, hot boolean, context binary"


def _contexts(length: int):
    """The windows of each repeated anchor: text from the first window to the end of the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                data, bounds = byte_data(part.column("text"))
                h, place, lo, hi = anchors(data, bounds, length)
                doc = np.searchsorted(bounds, place, side="right") - 1
                wanted, hot = [], []
                for b, places, marks in zip(bounds[:-1], part.column("places").to_pylist(), part.column("hots").to_pylist()):
                    for p, m in zip(places, marks):
                        wanted.append(np.frombuffer(p, dtype=np.uint32).astype(np.int64) + b)
                        hot.append(np.frombuffer(m, dtype=np.uint8))
                wanted = np.concatenate(wanted) if wanted else np.zeros(0, dtype=np.int64)
                hot = np.concatenate(hot) if hot else np.zeros(0, dtype=np.uint8)
                order = np.argsort(wanted, kind="stable")
                wanted, hot = wanted[order], hot[order]
                found = np.searchsorted(wanted, place)
                ok = (found < len(wanted)) & (wanted[np.minimum(found, len(wanted) - 1)] == place) if len(wanted) else np.zeros(len(place), dtype=bool)
                h, place, lo, hi, doc, found = h[ok], place[ok], lo[ok], hi[ok], doc[ok], found[ok]
                size = hi + length - lo
                flat = data[spread(lo, size)]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h.view(np.int64)), part.column("doc_id").take(take), part.column("key").take(take),
                    pa.array(lo - bounds[doc]), pa.array((hi - lo + 1).astype(np.int32)), pa.array(hot[found].astype(bool) if len(found) else np.zeros(0, dtype=bool)), context,
                ], names=["anchor", "doc_id", "key", "at", "own", "hot", "context"])
        give_back()

    return run


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each place on: widths double, the last step overlaps."""
    mul = 0x9E3779B97F4A7C15
    table = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h, width = table[data], 1
    while width < length:
        step = min(width, length - width)
        h = h[:-step] * np.uint64(pow(mul, step, 1 << 64) | 1) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        width += step
    return h


def suffix_intervals(data: np.ndarray, bounds: np.ndarray, own: np.ndarray, length: int):
    """Sparse suffix array of the window starts of contexts that repeat and can be left-maximal, with its common prefixes.

    Returns, in suffix order: context and place in it of each suffix, the byte before it (-1 at
    a context's begin), the length of the common prefix with the suffix before (0 under
    `length`), never beyond either context.

    Hashes of windows only sort out those that occur once or always after the same byte; the
    order and the common prefixes come from the bytes.
    """
    size = np.diff(bounds)
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    hashes = _window_hashes(padded, length)
    owner = np.repeat(np.arange(len(own)), own)
    at = spread(np.zeros(len(own), dtype=np.int64), own)
    place = bounds[:-1][owner] + at
    value = hashes[place]
    order = np.argsort(value)
    value, place = value[order], place[order]
    before = np.where(at[order] > 0, padded[np.maximum(place - 1, 0)].astype(np.int16), np.int16(-1))
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(start, len(value)))
    lo, hi = np.minimum.reduceat(before, start), np.maximum.reduceat(before, start)
    use = np.repeat((count > 1) & ((lo != hi) | (lo < 0)), count)
    owner, at, place, before = owner[order[use]], at[order[use]], place[use], before[use]
    left = size[owner] - at  # bytes of the suffix within its context
    columns = -(-int(left.max() if len(left) else 1) // 8)
    grid = np.arange(8 * columns)
    text = padded[np.minimum(place[:, None] + grid[None, :], len(padded) - 1)]
    text[grid[None, :] >= left[:, None]] = 0
    packed = text.view(">u8")
    order = np.lexsort((left, *(packed[:, c] for c in range(columns - 1, -1, -1))))
    owner, at, before, text, left = owner[order], at[order], before[order], text[order], left[order]
    lcp = np.zeros(len(owner), dtype=np.int64)
    if len(owner) > 1:
        differs = text[1:] != text[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), text.shape[1])
        same = np.minimum(same, np.minimum(left[1:], left[:-1]))
        lcp[1:] = np.where(same >= length, same, 0)
    return owner, at, before, lcp


def maximal_repeats(lcp: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals (first, end, common length) of the interval tree whose occurrences differ on the left.

    One stack scan: an interval closes when the common length falls below its own.
    """
    found, stack = [], []
    values = [*lcp.tolist(), 0]
    n = len(lcp)
    marks = before.tolist()
    for i in range(1, n + 1):
        begin = i - 1
        while stack and stack[-1][1] > values[i]:
            begin, depth = stack.pop()
            if i - begin == 2:
                a, b = marks[begin], marks[begin + 1]
                diverse = a < 0 or b < 0 or a != b
            else:
                part = before[begin:i]
                diverse = part.min() < 0 or part.min() != part.max()
            if diverse:
                found.append((begin, i, depth))
        if values[i] and (not stack or stack[-1][1] < values[i]):
            stack.append((begin, values[i]))
    return found


def _group_arrays(group: pa.Table):
    group = group.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("at", "ascending")]).combine_chunks()
    column = group.column("context")
    column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    data, bounds = byte_data(column)
    return group, data, bounds, group.column("own").to_numpy()


def _repeat_rows(length: int):
    """Every maximal repeat of a group: its number, length, and all occurrences."""
    def run(group: pa.Table) -> pa.Table:
        group, data, bounds, own = _group_arrays(group)
        owner, at, before, lcp = suffix_intervals(data, bounds, own, length)
        found = maximal_repeats(lcp, before)
        size = np.array([b - a for a, b, _ in found], dtype=np.int64)
        which = spread(np.array([a for a, _, _ in found], dtype=np.int64), size)
        rows = owner[which]
        start = group.column("at").to_numpy()[rows] + at[which]
        long = np.repeat(np.array([d for _, _, d in found], dtype=np.int64), size)
        take = pa.array(rows)
        return pa.table({"bucket": group.column("bucket").take(take), "repeat": pa.array(np.repeat(np.arange(len(found)), size)),
                         "length": pa.array(long), "doc_id": group.column("doc_id").take(take), "key": group.column("key").take(take),
                         "start": pa.array(start)})

    return run


def _removal_rows(length: int):
    """What a group removes, as merged spans of each document: occurrences of its repeats but the first."""
    def run(group: pa.Table) -> pa.Table:
        group, data, bounds, own = _group_arrays(group)
        owner, at, before, lcp = suffix_intervals(data, bounds, own, length)
        gone = np.zeros(len(owner), dtype=np.int64)
        doc_of = np.cumsum(np.concatenate([[0], (np.diff(group.column("doc_id").to_numpy()) != 0) | (np.diff(group.column("key").to_numpy()) != 0)])) \
            if group.num_rows else np.zeros(0, dtype=np.int64)
        begin = group.column("at").to_numpy()
        order = doc_of[owner] * np.int64(1 << 40) + begin[owner] + at
        for a, b, depth in maximal_repeats(lcp, before):
            if b - a == 2:
                i = a if order[a] > order[a + 1] else a + 1
                if gone[i] < depth:
                    gone[i] = depth
            else:
                first = a + int(np.argmin(order[a:b]))
                kept = gone[first]
                np.maximum(gone[a:b], depth, out=gone[a:b])
                gone[first] = kept
        hit = gone > 0
        rows, start, end = owner[hit], begin[owner[hit]] + at[hit], begin[owner[hit]] + at[hit] + gone[hit]
        sort = np.lexsort((start, doc_of[rows]))
        rows, start, end = rows[sort], start[sort], end[sort]
        if len(rows):
            doc = doc_of[rows]
            reach = np.maximum.accumulate(end + doc * np.int64(1 << 40)) - doc * np.int64(1 << 40)
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
            heads = np.flatnonzero(fresh)
            end = np.maximum.reduceat(end, heads)
            rows, start = rows[heads], start[heads]
        take = pa.array(rows)
        return pa.table({"doc_id": group.column("doc_id").take(take), "key": group.column("key").take(take),
                         "start": pa.array(start), "end": pa.array(end)})

    return run


def _hot_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, digest = [], [], []
            for i, (at, own, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "own", "context")))):
                for j in range(own):
                    row.append(i)
                    start.append(at + j)
                    digest.append(hashlib.blake2b(context[j:j + length], digest_size=16).digest())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(start, pa.int64()), pa.array(digest, pa.binary())],
                names=["doc_id", "key", "start", "window"])

    return run


def _prepare(docs: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with id, key and text; the written table of digests; contexts of repeated anchors."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = settle(rows.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"),
                               F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    count = max(spark.sparkContext.defaultParallelism, -(-2 * total // (length - K + 2) // BUCKET_ANCHORS))
    blobs = rows.where("doc_id IS NOT NULL").select("key", "text").mapInArrow(
        _anchor_blobs(count, length), "bucket int, key binary, at binary, place binary, h binary")
    told = blobs.groupBy("bucket").applyInArrow(_repeated, "key bigint, place binary, hot binary")
    heads = facts.where(f"doc_id IS NOT NULL AND n_bytes >= {length}").groupBy("sha256", "key").agg(F.min("doc_id").alias("doc_id"))
    places = told.groupBy("key").agg(F.collect_list("place").alias("places"), F.collect_list("hot").alias("hots"))
    wanted = heads.select("doc_id", "key").join(places, "key")
    cut = rows.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])  # repeated rows are one document
    contexts = cut.select("doc_id", "key", "text", "places", "hots").mapInArrow(_contexts(length), CONTEXT)
    contexts = settle(contexts, "contexts")
    size = contexts.agg(F.sum(F.length("context"))).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    return rows, facts, contexts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))


def repeat_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Maximal repeats of at least `length` bytes within anchor contexts: bucket, repeat, length, doc_id, key, start.

    Rows with the same (bucket, repeat) are all occurrences of one string. A longer repeat
    shows as a chain of overlapping ones; whole copies show with their first document only.
    """
    contexts = _prepare(docs, doc_id, text, length)[2]
    return contexts.groupBy("bucket").applyInArrow(
        _repeat_rows(length), "bucket int, repeat bigint, length bigint, doc_id bigint, key bigint, start bigint")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        out = {"n_removed": [], "n_spans": [], "kept": []}
        for value, spans in zip(texts, batch.column("spans").to_pylist()):
            data, removed, runs, end, kept = value.as_buffer(), 0, 0, 0, []
            for span in spans:
                a, b = span["start"], span["end"]
                if a > end or not runs:
                    kept.append(data[end:a] if a > end else b"")
                    runs += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
            kept.append(data[end:])
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept"].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
             pa.array(out["kept"], pa.binary())], names=["doc_id", "key", "n_removed", "n_spans", "kept"])


def removed_spans(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, key, start, end of what goes, unmerged across groups."""
    cold = contexts.where("NOT hot").drop("hot", "anchor").groupBy("bucket").applyInArrow(
        _removal_rows(length), "doc_id bigint, key bigint, start bigint, end bigint")
    hot = contexts.where("hot").select("doc_id", "key", "at", "own", "context")
    if hot.isEmpty():
        return cold
    windows = settle(hot.mapInArrow(_hot_windows(length), "doc_id bigint, key bigint, start bigint, window binary"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"))
    # every window starts at a place of its own, so what is not a first place goes: no join on a frequent window
    later = windows.join(first.select("first.*"), ["doc_id", "key", "start"], "left_anti")
    return cold.union(later.select("doc_id", "key", "start", (F.col("start") + length).alias("end")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (bytes left; null where the text stays whole), sha256 of what is left.

    A byte goes if a string of `length` bytes over it starts earlier too: in a document of a
    lesser id, or earlier in the same. Texts count as UTF-8 bytes, null as empty. Rows that repeat id
    and text are one document; rows of one id and different texts follow each other by the
    hash of their text. Rows with a null id stay whole and are no source. Other columns are
    not read; an empty table gives an empty table.
    """
    rows, facts, contexts = _prepare(docs, doc_id, text, length)
    spans = removed_spans(contexts, length)
    listed = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    texts = rows.join(listed, ["doc_id", "key"]).select("doc_id", "key", "text", "spans")
    cut = texts.mapInArrow(_cut_out, "doc_id bigint, key bigint, n_removed bigint, n_spans bigint, kept binary")
    cut = cut.dropDuplicates(["doc_id", "key"]).withColumn("cut_sha256", F.sha2("kept", 256))
    first = facts.where("doc_id IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    known = facts.join(first, "sha256", "left").join(cut, ["doc_id", "key"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    return known.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )
