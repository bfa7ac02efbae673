"""Similarity join of documents on word n-grams (shingles) with adaptive multi-match prefixes.

1. Documents with equal shingle sets are one class; only classes are compared.
2. Each shingle's document frequency is counted. Tasks send shingles as sorted blobs by
   hash range, and only shingles of two classes or more come back to their classes. A class
   needs a share `threshold` of its shingles in common with a partner, so classes with fewer
   repeated shingles leave: the rest is small.
3. Shingles are ordered from rare to frequent. If two sets reach the threshold, they share at
   least l of their first |x| - ceil(t |x|) + l shingles, for every l. Each class chooses its
   l by estimated cost; two classes are compared if they share min(l_x, l_y) shingles of the
   prefixes that go with that number.
4. Classes that share a prefix shingle meet in a group. Within it, verified links grow
   components; a class already in one is not compared with it again, and a component leaves
   as a star. Groups over `MAX_GROUP` are cut in blocks: each block first, then pairs of
   blocks that still hold different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import give_back, settle
from jurybox.llm.components import components
from jurybox.llm.tokens import chunks, spread

CHUNK_BYTES = 8 << 20
SET_BYTES = 2 << 20  # text whose sets are hashed at once; sets are made row by row, so this only bounds memory
BUCKET_SHINGLES = 3_000_000  # shingles a frequency group holds, on average
HEAVY_PART = 200  # shingles in over 1/200 of the documents are spread by class, not by hash
MAX_LEVEL = 4
MAX_GROUP = 2_000
BITS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and the bounds of each text's.

    A-Z in lower case, words without white space. A text of fewer than n words is one
    shingle of all; a text without words has none.
    """
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    runs = parts.flatten().dictionary_encode()
    names = runs.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    full = np.fromiter((w != "" for w in names), dtype=bool, count=len(names))
    codes = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = full[codes] if len(codes) else np.zeros(0, dtype=bool)
    places = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(real)])[places - places[0]]
    words = hashes[codes[real]] if len(codes) else np.zeros(0, dtype=np.uint64)
    sizes = np.diff(at)

    def rolled(starts: np.ndarray, width: int) -> np.ndarray:
        acc = np.full(len(starts), width, dtype=np.uint64)
        for j in range(width):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[starts + j])
        return acc

    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(bounds[-1]), dtype=np.uint64)
    long = sizes >= n
    out[spread(bounds[:-1][long], counts[long])] = rolled(spread(at[:-1][long], counts[long]), n)
    for width in range(1, n):
        short = sizes == width
        out[bounds[:-1][short]] = rolled(at[:-1][short], width)
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(out), dtype=bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty sets."""
    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    k1 = sums(_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    k2 = sums(_mix(hashes ^ np.uint64(0x14057B7EF767814F)))
    return _mix(k1).view(np.int64), _mix(k2).view(np.int64)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SET_BYTES):
                hashes, bounds = shingles(part.column("text"), n)
                k1, k2 = _keys(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds))],
                    names=["doc_id", "k1", "k2", "n"])
        give_back()

    return run


def _heavy_candidates(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                hashes, _ = shingles(part.column("text"), n)
                values, counts = np.unique(hashes >> np.uint64(64 - BITS), return_counts=True)
                often = counts * HEAVY_PART * 2 >= max(part.num_rows, 4 * HEAVY_PART)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[often].astype(np.int64)), pa.array(counts[often])], names=["h", "c"])
        give_back()

    return run


def _blob(values: np.ndarray) -> bytes:
    return values.tobytes()


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted values as 32-bit steps where they fit, else as they are; the first byte says which."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    if len(steps) > 1 and steps[1:].max() < 1 << 32:
        return b"d" + sorted_values[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"r" + sorted_values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, dtype=np.uint64, offset=1)
    first = np.frombuffer(data, dtype=np.uint64, count=1, offset=1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(data, dtype=np.uint32, offset=9), dtype=np.uint64)])


REQUEST = "bucket int, k1 binary, k2 binary, n binary, at binary, h binary"
REPLY = "slot int, k1 binary, k2 binary, n binary, size binary, h binary, df binary"


def _requests(n: int, buckets: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                hashes, bounds = shingles(part.column("text"), n)
                k1, k2 = _keys(hashes, bounds)
                size = np.diff(bounds)
                _, first = np.unique(np.stack([k1, k2]), axis=1, return_index=True)  # copies within the chunk once
                first = first[size[first] > 0]
                values = (hashes >> np.uint64(64 - BITS))[spread(bounds[first], size[first])]
                owner = np.repeat(first, size[first])
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                bucket = (values * np.uint64(buckets) >> np.uint64(BITS)).astype(np.int64)
                often = np.isin(values, known)
                bucket[often] = buckets + (k1[owner[often]] % buckets)
                order = np.argsort(bucket, kind="stable")
                values, owner, bucket = values[order], owner[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=2 * buckets + 1))
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    classes, at = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), _blob(k1[classes]), _blob(k2[classes]), _blob(size[classes].astype(np.int32)),
                                 _blob(at.astype(np.uint32 if len(classes) > 65535 else np.uint16)), _pack(values[a:b])))
                if rows:
                    kinds = [pa.int32(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "k1", "k2", "n", "at", "h"])
        give_back()

    return run


def _frequencies(slots: int, buckets: int, heavy_size):
    """Group of one bucket: frequency of each shingle over classes; repeated ones go back by class."""
    def run(group: pa.Table) -> pa.Table:
        k1, k2, n, at, h, base = [], [], [], [], [], 0
        bucket = group.column("bucket")[0].as_py()
        for i in range(group.num_rows):
            row = {c: group.column(c)[i].as_py() for c in ("k1", "k2", "n", "at", "h")}
            a = np.frombuffer(row["k1"], dtype=np.int64)
            k1.append(a)
            k2.append(np.frombuffer(row["k2"], dtype=np.int64))
            n.append(np.frombuffer(row["n"], dtype=np.int32))
            v = _unpack(row["h"])
            at.append(np.frombuffer(row["at"], dtype=np.uint16 if 2 * len(v) == len(row["at"]) else np.uint32).astype(np.int32) + np.int32(base))
            h.append(v)
            base += len(a)
        del group
        k1, k2, n = map(np.concatenate, (k1, k2, n))
        at = np.concatenate(at)
        h = np.concatenate(h)
        _, first, same = np.unique(np.stack([k1, k2]), axis=1, return_index=True, return_inverse=True)
        owner = same.reshape(-1).astype(np.int32)[at]
        del at
        # a class whose copies lie in several chunks asks several times
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        del order
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        if bucket >= buckets:
            known, counts = heavy_size.value
            df = counts[np.searchsorted(known, h)]
            keep = np.ones(len(h), dtype=bool)
        else:
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            df = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
            keep = df > 1
        h, owner, df = h[keep], owner[keep], df[keep]
        slot = (k2[first][owner] % slots).astype(np.int64)
        order = np.lexsort((owner, slot))
        h, owner, df, slot = h[order], owner[order], df[order], slot[order]
        edges = np.flatnonzero(np.diff(slot, prepend=-1, append=slots))
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            classes, size = np.unique(owner[a:b], return_counts=True)
            src = first[classes]
            rows.append({"slot": int(slot[a]), "k1": _blob(k1[src]), "k2": _blob(k2[src]), "n": _blob(n[src]),
                         "size": _blob(size.astype(np.int32)), "h": _blob(h[a:b]),
                         "df": _blob(np.minimum(df[a:b], 2**32 - 1).astype(np.uint32))})
        kinds = pa.schema([("slot", pa.int32()), *[(c, pa.binary()) for c in ("k1", "k2", "n", "size", "h", "df")]])
        give_back()
        return pa.Table.from_pylist(rows, schema=kinds)

    return run


def need(n: np.ndarray | int, threshold: int):
    """Least overlap with any partner of a set of n: ceil(n * threshold / 100)."""
    return -(-n * threshold // 100)


def choose_level(n: int, r: int, df: np.ndarray, threshold: int) -> int:
    """The number of shared prefix shingles to ask for, by estimated cost.

    `df` are the frequencies of the r repeated shingles, rare first. A prefix of level l
    reads all their lists; a list entry costs 1, and a candidate, which appears in at least l
    of the lists, costs as much as reading a tenth of the set.
    """
    best, level = None, 1
    for l in range(1, MAX_LEVEL + 1):
        p = n - need(n, threshold) + l - (n - r)
        if p > r:
            break
        read = float(df[:max(p, 0)].sum())
        cost = read + read / l * (n / 10)
        if best is None or cost < best:
            best, level = cost, l
    return level


def _assemble(threshold: int):
    """Group of classes: all repeated shingles of each, rare first; only classes that can have a partner."""
    def run(group: pa.Table) -> pa.Table:
        k1, k2, n, size, h, df = [], [], [], [], [], []
        for row in group.to_pylist():
            for out, name, kind in ((k1, "k1", np.int64), (k2, "k2", np.int64), (n, "n", np.int32), (size, "size", np.int32),
                                    (h, "h", np.uint64), (df, "df", np.uint32)):
                out.append(np.frombuffer(row[name], dtype=kind))
        k1, k2, n, size, h, df = map(np.concatenate, (k1, k2, n, size, h, df))
        keys, first, same = np.unique(np.stack([k1, k2]), axis=1, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        total = np.bincount(same, weights=size).astype(np.int64)
        good = total >= need(n[first].astype(np.int64), threshold)
        owner = np.repeat(same, size)
        keep = good[owner]
        h, df, owner = h[keep], df[keep], owner[keep]
        order = np.lexsort((h, df, owner))
        h, df, owner = h[order], df[order], owner[order]
        rows = []
        bounds = np.searchsorted(owner, np.arange(len(first) + 1))
        for c in np.flatnonzero(good):
            a, b = bounds[c], bounds[c + 1]
            m = int(n[first[c]])
            rows.append({"key": keys[:, c].astype(">i8").tobytes(), "n": m, "level": choose_level(m, b - a, df[a:b], threshold),
                         "h": h[a:b].tobytes()})
        give_back()
        return pa.Table.from_pylist(rows, schema=pa.schema(
            [("key", pa.binary()), ("n", pa.int32()), ("level", pa.int32()), ("h", pa.binary())]))

    return run


def _prefix_size(n: int, r: int, level: int, threshold: int) -> int:
    """Repeated shingles in the prefix of a level; the n - r others come first and match nothing."""
    return max(0, n - need(n, threshold) + level - (n - r))


def _prefixes(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys = [], []
            for key, n, level, h in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "level", "h"))):
                values = np.frombuffer(h, dtype=np.int64)
                prefix = values[:_prefix_size(n, len(values), level, threshold)]
                tokens.append(prefix)
                keys += [key] * len(prefix)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(keys, pa.binary())], names=["token", "key"])

    return run


def link_group(keys: list[bytes], n: np.ndarray, level: np.ndarray, sets: list[np.ndarray], label: list[bytes], threshold: int) -> list[tuple[bytes, bytes]]:
    """Links within one group, as stars; members with the same label count as linked already.

    `sets` hold each member's repeated shingles, rare first. A member is compared with those
    outside its component that share enough prefix shingles; overlaps with all of them are
    counted at once over inverted lists.
    """
    m = len(keys)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[bytes, int] = {}
    for i, one in enumerate(label):
        parent[root(i)] = root(seen.setdefault(one, i))

    def lists(parts: list[np.ndarray], marks: list[np.ndarray] | None = None):
        size = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        mark = np.concatenate(marks)[order] if marks else None
        return flat, owner, mark

    prefix_of = [s[:_prefix_size(int(a), len(s), int(l), threshold)] for s, a, l in zip(sets, n, level)]
    # the lowest level whose prefix holds the shingle
    marks = [np.maximum(1, np.arange(len(p)) + 1 - _prefix_size(int(a), len(s), 0, threshold)) for p, s, a in zip(prefix_of, sets, n)]
    pre = lists(prefix_of, marks)
    whole = None
    for x in range(m):
        lo, hi = np.searchsorted(pre[0], prefix_of[x], "left"), np.searchsorted(pre[0], prefix_of[x], "right")
        at = spread(lo, hi - lo)
        other = pre[1][at]
        low = np.minimum(level[x], level[other])
        fits = (pre[2][at] <= low) & (np.repeat(marks[x], hi - lo) <= low)
        shared = np.bincount(other[fits], minlength=m)
        ok = (shared >= np.minimum(level[x], level)) & (100 * np.minimum(n[x], n) >= threshold * np.maximum(n[x], n))
        ok[x] = False
        mine = root(x)
        todo = [int(y) for y in np.flatnonzero(ok) if root(int(y)) != mine]
        if not todo:
            continue
        if len(todo) > 6:
            if whole is None:
                whole = lists(sets)
            lo, hi = np.searchsorted(whole[0], np.sort(sets[x]), "left"), np.searchsorted(whole[0], np.sort(sets[x]), "right")
            overlap = np.bincount(whole[1][spread(lo, hi - lo)], minlength=m)
        else:
            overlap = {y: len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in todo}
        for y in todo:
            if root(y) != root(x) and (100 + threshold) * int(overlap[y]) >= threshold * int(n[x] + n[y]):
                parent[root(y)] = root(x)
    least: dict[int, bytes] = {}
    for i in range(m):
        r = root(i)
        least[r] = min(least.get(r, keys[i]), keys[i])
    return [(least[root(i)], keys[i]) for i in range(m) if keys[i] != least[root(i)]]


def _link(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        found = link_group(rows["key"], np.array(rows["n"], dtype=np.int64), np.array(rows["level"], dtype=np.int64),
                           [np.frombuffer(h, dtype=np.int64) for h in rows["h"]], rows["label"], threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


def classes_of(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table doc_id, k1, k2, n: each document's set size and the class of its set."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return settle(rows.mapInArrow(_sets(n), f"doc_id {kind}, k1 bigint, k2 bigint, n bigint"), "sets")


def class_links(docs: DataFrame, sets: DataFrame, n: int, threshold: int, text: str = "text") -> DataFrame:
    """Links between classes as a written table a, b of 16-byte class keys; enough to join all that are linked."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    total, count = sets.agg(F.sum("n"), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // BUCKET_SHINGLES), 1)
    # Shingles in over 1/HEAVY_PART of the documents: at most 2 * HEAVY_PART times the mean set size.
    often = texts.mapInArrow(_heavy_candidates(n), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    often = sorted((r["h"], r["c"]) for r in often.where(F.col("c") * (2 * HEAVY_PART) >= max(count, 8 * HEAVY_PART)).collect())
    known = np.array([h for h, _ in often], dtype=np.uint64)
    heavy = spark.sparkContext.broadcast(known)
    sized = spark.sparkContext.broadcast((known, np.array([c for _, c in often], dtype=np.int64)))
    asked = texts.mapInArrow(_requests(n, buckets, heavy), REQUEST)
    told = asked.groupBy("bucket").applyInArrow(_frequencies(buckets, buckets, sized), REPLY)
    survivors = settle(told.groupBy("slot").applyInArrow(_assemble(threshold), "key binary, n int, level int, h binary"), "survivors")
    narrow = survivors.mapInArrow(_prefixes(threshold), "token bigint, key binary")
    # One shingle for each distinct list of classes: neighbours in a text mostly have the same.
    lists = narrow.groupBy("token").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("key") % 2**31).alias("s1"), F.sum(F.xxhash64(F.lit(1), "key") % 2**31).alias("s2"))
    chosen = lists.where("m > 1").groupBy("m", "s1", "s2").agg(F.min("token").alias("token")).select("token", "m")
    members = settle(narrow.join(chosen, "token"), "members")
    blocks = F.ceil(F.col("m") / MAX_GROUP).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    first = placed.select("token", "block", "block", "key").toDF("token", "i", "j", "key")
    edges = settle(_linked(first.join(survivors, "key").withColumn("label", F.col("key")), threshold), "links")
    cut = placed.where("blocks > 1")
    if cut.isEmpty():
        return edges
    labels = components(edges)
    named = cut.join(labels, cut["key"] == labels["node"], "left").select("token", "key", "block", "blocks", F.coalesce("label", "key").alias("label"))
    several = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    open_rows = named.join(several, "token")
    pairs = open_rows.select("token", "key", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")).where("block <> to")
    pairs = pairs.select("token", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "key", "label")
    more = settle(_linked(pairs.join(survivors, "key"), threshold), "links")
    return edges.union(more)


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    picked = rows.select("token", "i", "j", "key", "n", "level", "h", "label")
    return picked.groupBy("token", "i", "j").applyInArrow(_link(threshold), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, the least id reachable over links.

    Two documents link when 100 * |intersection| >= threshold * |union| of their distinct
    n-word shingles. Null and empty texts have no shingles and link with nothing. Rows
    that share an id are one node; repeated rows are returned as often as they come. A null
    id takes part in no link and its component is null. Other columns are not read; an
    empty table gives an empty table.
    """
    sets = classes_of(docs, n, doc_id, text)
    edges = class_links(docs, sets, n, threshold, text)
    key = F.concat(_bytes("k1"), _bytes("k2"))
    named = sets.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id"), key.alias("key"))
    linked = components(edges)
    roots = named.join(linked, named["key"] == linked["node"], "left").select("doc_id", F.coalesce("label", "key").alias("root"))
    # rows with the same id join their classes
    shared = roots.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    if not shared.isEmpty():
        merged = components(roots.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("root").alias("b")))
        roots = roots.join(merged, roots["root"] == merged["node"], "left").select("doc_id", F.coalesce("label", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = roots.distinct().join(least, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sets.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _bytes(column: str):
    """A 64-bit column as its 8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the least of their component, once each; rows with a null id stay.

    Texts that share an id are one document: they stay or go together, and one row of them stays. Which
    one it is, where their texts differ, is not fixed; give every text an id of its own.
    """
    found = near_duplicates(docs.where(F.col(doc_id).isNotNull()), n, threshold, doc_id, text)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    kept = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).union(kept.where(F.col(doc_id).isNull()))
