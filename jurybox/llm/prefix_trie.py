"""The trie of all conversations: which prefixes conversations share, and what sharing them saves.

Every conversation is its sequence of 16-byte turn digests. Distinct sequences are range-partitioned
and sorted, so that a partition holds a run of the trie in preorder; it is read as shards of bounded
size. A shard is a balanced-parentheses string: excess minima and maxima of blocks, and of pairs of
them up to one, give each node's closing parenthesis, hence its subtree as a range; counts of leaf
pairs and running sums over preorder give its numbers.

Only nodes on a shard's first and last path can go on in another shard. All others are final. What
they hold is folded into the lowest node above them that goes on, and these spines are, in order,
the input of the next level, whose shards merge them in the same way, until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import settle
from jurybox.operators.joins import lookup_join

DIGEST = 16  # bytes of a turn's digest
FAMILY = 5  # conversations c - c % 5 to c - c % 5 + 4 share a beginning
SHARED = 9  # the first crc32(c) % 9 turns
SHARD_NODES = 1 << 17  # a shard ends with the sequence that reaches this number of nodes
FAN = 256  # partitions whose spines one task of the next level merges
RANGE_BYTES = 1024  # bytes of a sequence that decide its partition
BLOCK = 64
NONE = np.iinfo(np.int64).max  # smallest member where there is none

COUNT, LEAVES, SAVED, CHILDREN, LEAST = range(5)  # rows of a node's local numbers


class Parentheses:
    """A balanced string of parentheses with the range min-max tree of its excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.int64)  # beyond the end the excess stays 0
        padded[:len(bits)] = self.excess
        lows, highs = padded.reshape(blocks, BLOCK).min(1), padded.reshape(blocks, BLOCK).max(1)
        self.tree = [(lows, highs)]
        while len(lows) > 1:
            if len(lows) % 2:
                lows, highs = np.append(lows, lows[-1]), np.append(highs, highs[-1])
                self.tree[-1] = (lows, highs)
            lows, highs = lows.reshape(-1, 2).min(1), highs.reshape(-1, 2).max(1)
            self.tree.append((lows, highs))

    def _scan(self, start: np.ndarray, target: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First place from `start` on, before `stop`, with the excess `target`; -1 without one."""
        found = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(start < stop)
        for k in range(BLOCK):
            if not len(live):
                break
            hit = self.excess[start[live] + k] == target[live]
            found[live[hit]] = start[live[hit]] + k
            live = live[~hit]
            live = live[start[live] + k + 1 < stop[live]]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening place: the first after it with one less excess."""
        n = len(self.bits)
        target = self.excess[opens] - 1
        block = opens // BLOCK
        found = self._scan(opens + 1, target, np.minimum((block + 1) * BLOCK, n))
        live = np.flatnonzero(found < 0)
        at, level = block[live].copy(), np.zeros(len(live), np.int64)
        climbing = np.ones(len(live), bool)
        for height, (lows, highs) in enumerate(self.tree):
            right = np.minimum(at + 1, len(lows) - 1)
            holds = climbing & (at % 2 == 0) & (at + 1 < len(lows)) & (lows[right] <= target[live]) & (highs[right] >= target[live])
            at[holds], level[holds] = right[holds], height
            climbing &= ~holds
            at[climbing] //= 2
        for height in range(len(self.tree) - 1, 0, -1):
            lows, highs = self.tree[height - 1]
            down = level == height
            left = at[down] * 2
            inside = (lows[left] <= target[live][down]) & (highs[left] >= target[live][down])
            at[down] = np.where(inside, left, left + 1)
            level[down] = height - 1
        found[live] = self._scan(at * BLOCK, target[live], np.minimum((at + 1) * BLOCK, n))
        return found


def _range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] for each of many ranges, by a tree of minima."""
    size = len(values)
    tree = np.full(2 * size, NONE, np.int64)
    tree[size:] = values
    # Bottom up; each pass halves the places still to fill.
    high = size
    while high > 1:
        low = (high + 1) // 2
        at = np.arange(low, high)
        tree[at] = np.minimum(tree[2 * at], tree[2 * at + 1])
        high = low
    out = np.full(len(begin), NONE, np.int64)
    left, right = begin + size, end + size
    live = np.flatnonzero(left < right)
    while len(live):
        lo, hi = left[live], right[live]
        odd = lo % 2 == 1
        out[live[odd]] = np.minimum(out[live[odd]], tree[lo[odd]])
        lo = lo + odd
        odd = hi % 2 == 1
        hi = hi - odd
        out[live[odd]] = np.minimum(out[live[odd]], tree[hi[odd]])
        left[live], right[live] = lo // 2, hi // 2
        live = live[left[live] < right[live]]
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:high * DIGEST] == b[:high * DIGEST]:
        return high
    width = 1
    while low + width <= high and a[low * DIGEST:(low + width) * DIGEST] == b[low * DIGEST:(low + width) * DIGEST]:
        low, width = low + width, 2 * width
    high = min(high, low + width)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST:middle * DIGEST] == b[low * DIGEST:middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def path_keys(path: bytes) -> list[bytes]:
    """A key of every prefix of a sequence, by depth."""
    state = hashlib.blake2b(digest_size=DIGEST)
    keys = [state.digest()]
    for at in range(0, len(path), DIGEST):
        state.update(path[at:at + DIGEST])
        keys.append(state.digest())
    return keys


class Shard:
    """A run of sequences in order, as the trie of their prefixes."""

    def __init__(self, left_depth: int) -> None:
        self.left_depth = left_depth  # nodes of the first path up to this depth go on before the shard
        self.first_path = b""
        self.n = 0
        self.size = np.zeros(1024, np.int64)
        self.parent = np.zeros(1024, np.int64)
        self.depth = np.zeros(1024, np.int64)
        self.local = np.zeros((5, 1024), np.int64)
        self.ends: dict[int, bytes] = {}
        self.keys: list[bytes] = []
        self.stack: list[int] = []
        self.runs: list[int] = []

    def _room(self, n: int) -> None:
        have = len(self.size)
        if n > have:
            more = max(n, 2 * have) - have
            self.size, self.parent, self.depth = (np.append(a, np.zeros(more, np.int64)) for a in (self.size, self.parent, self.depth))
            self.local = np.concatenate([self.local, np.zeros((5, more), np.int64)], axis=1)

    def add(self, path: bytes, sizes: np.ndarray, shared: int) -> None:
        """Open the nodes of the next sequence; it shares its first `shared` turns with the one before, the first -1."""
        depth = len(path) // DIGEST
        new = depth - shared
        begin, end = self.n, self.n + new
        self._room(end)
        if shared < 0:
            self.first_path = path
        self.runs += [len(self.stack) - 1 - shared, new]
        if new:
            self.depth[begin:end] = np.arange(shared + 1, depth + 1)
            self.size[begin:end] = sizes[shared + 1:depth + 1]
            self.parent[begin:end] = np.arange(begin - 1, end - 1)
            self.parent[begin] = self.stack[shared] if shared >= 0 else -1
            self.local[LEAST, begin:end] = NONE
        del self.stack[shared + 1:]
        self.stack.extend(range(begin, end))
        self.n = end

    def put(self, local: np.ndarray) -> None:
        """Add local numbers to the nodes of the last path, from the root on."""
        nodes = np.array(self.stack[:local.shape[1]])
        self.local[:LEAST, nodes] += local[:LEAST]
        self.local[LEAST, nodes] = np.minimum(self.local[LEAST, nodes], local[LEAST])

    def finish(self, last_path: bytes, right_depth: int) -> tuple[dict[str, np.ndarray], list[dict]]:
        """Numbers of the final nodes, and the one or two paths of nodes that go on."""
        n = self.n
        size, parent, depth, local = self.size[:n], self.parent[:n], self.depth[:n], self.local[:, :n]
        bits = np.repeat(np.arange(len(self.runs) + 1) % 2 == 1, [*self.runs, len(self.stack)])
        paren = Parentheses(bits)
        opens = np.flatnonzero(bits)
        close = paren.find_close(opens)
        begin, end = np.arange(n), np.arange(n) + (close - opens + 1) // 2
        goes_on = np.zeros(n, bool)
        goes_on[:self.left_depth + 1] = True
        right = self.stack[:right_depth + 1]
        goes_on[right] = True

        def subtree(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[begin]

        children = local[CHILDREN] + np.bincount(parent[parent >= 0], minlength=n)
        members = subtree(local[COUNT])
        saved = subtree(local[SAVED] + np.where(goes_on, 0, (members - 1) * size))
        # Leaf pairs: an opening place and its closing place side by side, and nothing folded below.
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[opens + 1] = (close == opens + 1) & (children == 0) & ~goes_on
        rank = np.cumsum(pair)
        leaves = rank[close] - rank[opens] + subtree(local[LEAVES])
        least = _range_min(local[LEAST], begin, end)

        top = np.flatnonzero(~goes_on & (parent >= 0) & goes_on[parent])
        above = parent[top]
        for row, values in ((COUNT, members), (LEAVES, leaves), (SAVED, saved), (CHILDREN, np.ones(n, np.int64))):
            np.add.at(local[row], above, values[top])
        np.minimum.at(local[LEAST], above, least[top])

        done = np.flatnonzero(~goes_on)
        up = parent[done]
        open_parent = (up >= 0) & goes_on[up]
        left_nodes = list(range(self.left_depth + 1))
        paths = [(self.first_path, left_nodes), (last_path, right)]
        key_of = {node: key for path, nodes in paths if nodes for node, key in zip(nodes, path_keys(path[:(len(nodes) - 1) * DIGEST]))}
        final = {
            "node": done, "conv_id": least[done], "depth": depth[done], "n_convs": members[done], "n_children": children[done],
            "n_leaves": leaves[done], "saved_tokens": saved[done],
            "parent_conv_id": np.where(open_parent | (up < 0), NONE, least[up]),
            "parent_key": [key_of[p] if o else None for p, o in zip(up.tolist(), open_parent.tolist())],
        }
        spines, given = [], -1
        for path, nodes in paths:
            if not nodes or nodes[-1] <= given:
                continue  # all of the last path's nodes are on the first
            own = local[:, nodes].copy()
            own[:, np.array(nodes) <= given] = np.array([[0], [0], [0], [0], [NONE]])
            spines.append({
                "path": path[:(len(nodes) - 1) * DIGEST], "sizes": size[nodes].tobytes(), "local": own.tobytes(),
                "ends": b"".join(self.ends.get(v, b"") if v > given else b"" for v in nodes),
                "ended": np.array([v > given and v in self.ends for v in nodes]).tobytes(),
            })
            given = max(given, nodes[-1])
        return final, spines


SPINE = {"task": "bigint", "seq": "bigint", "path": "binary", "sizes": "binary", "local": "binary", "ends": "binary", "ended": "binary"}
FINAL = {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
         "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string", "key": "binary", "parent_key": "binary"}
FOLDED = ", ".join(f"{name} {kind}" for name, kind in (FINAL | SPINE).items())
_TYPES = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of folded rows; columns not given are null."""
    kinds = FINAL | SPINE
    return pa.RecordBatch.from_arrays(
        [columns.get(c, pa.nulls(n, _TYPES[k])) for c, k in kinds.items()], list(kinds))


def _fold(level: int, last: bool, shard_nodes: int):
    """Shards of one partition's sequences (level 1) or spines: final nodes, and spines for the next level."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def fill(shard: Shard, row: dict, shared: int) -> None:
        path, before = row["path"], shard.n
        if level == 1:
            shard.add(path, np.concatenate([[0], np.frombuffer(row["sizes"], np.int64)]), shared)
            shard.local[[COUNT, LEAST], shard.stack[-1]] = row["n"], row["conv_id"]
            shard.ends[shard.stack[-1]] = row["ends"]
            return
        shard.add(path, np.frombuffer(row["sizes"], np.int64), shared)
        shard.put(np.frombuffer(row["local"], np.int64).reshape(5, -1))
        ended = np.flatnonzero(np.frombuffer(row["ended"], bool)).tolist()
        for k, d in enumerate(ended):
            shard.ends[shard.stack[d]] = row["ends"][32 * k:32 * k + 32]
        if shard.n > before:
            shard.keys.extend(path_keys(path)[len(shard.stack) - (shard.n - before):])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        shard: Shard | None = None
        before = b""

        def close(right_depth: int) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            final, spines = shard.finish(before, right_depth)
            nodes = final.pop("node").tolist()
            parents = final.pop("parent_conv_id")
            columns = {c: pa.array(v) for c, v in final.items() if c != "parent_key"}
            columns["parent_key"] = pa.array(final["parent_key"], pa.binary())
            columns["parent_conv_id"] = pa.array(parents, mask=parents == NONE)
            columns["ends_sha256"] = pa.array([e.hex() if (e := shard.ends.get(v)) else NO_ENDS for v in nodes], pa.string())
            if level > 1:
                columns["key"] = pa.array([shard.keys[v] for v in nodes], pa.binary())
            if nodes:
                yield _rows(columns, len(nodes))
            if spines:
                numbers = {"task": [task] * len(spines), "seq": list(range(seq, seq + len(spines)))}
                named = {c: pa.array([s[c] for s in spines], pa.binary()) for c in spines[0]}
                yield _rows({c: pa.array(v, pa.int64()) for c, v in numbers.items()} | named, len(spines))
                seq += len(spines)

        for row in records(batches):
            shared = -1 if shard is None else common_turns(before, row["path"])
            if shard is not None and shard.n >= shard_nodes and not last:
                yield from close(shared)
                shard, cut, shared = None, shared, -1
            else:
                cut = -1 if last else len(row["path"]) // DIGEST
            if shard is None:
                shard = Shard(cut)
            fill(shard, row, shared)
            before = row["path"]
        if shard is not None:
            yield from close(-1 if last else len(before) // DIGEST)

    return fold


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by family, conversation and place to one row per rebuilt conversation."""
    names, types = ["conv_id", "key", "path", "sizes"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    out: list[tuple] = []
    weight = 0
    base_of, base = None, (b"", b"")
    conv = family = borrowed = None
    held: list[tuple[bytes, bytes]] = []

    def close() -> None:
        nonlocal base_of, base, weight
        path, sizes = (b"".join(part) for part in zip(*held))
        if conv == family:
            base_of, base = family, (path[:SHARED * DIGEST], sizes[:SHARED * 8])
        lead = base if base_of == family else (b"", b"")
        path = lead[0][:borrowed * DIGEST] + path[borrowed * DIGEST:]
        sizes = lead[1][:borrowed * 8] + sizes[borrowed * 8:]
        out.append((conv, hashlib.blake2b(path, digest_size=DIGEST).digest(), path, sizes))
        weight += len(path) + 100

    def batch() -> pa.RecordBatch:
        nonlocal weight
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)], names)
        out.clear()
        weight = 0
        return done

    for rows in batches:
        ids = rows.column("conv_id").to_numpy()
        if not len(ids):
            continue
        families, leads = rows.column("family").to_numpy(), rows.column("borrowed").to_numpy()
        digests = b"".join(rows.column("digest").to_pylist())
        sizes = rows.column("size").to_numpy().astype(np.int64).tobytes()
        bounds = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for b, e in zip(bounds[:-1], bounds[1:]):
            if ids[b] != conv:
                if conv is not None:
                    close()
                    if weight > 1 << 22:
                        yield batch()
                conv, family, borrowed, held = int(ids[b]), int(families[b]), int(leads[b]), []
            held.append((digests[b * DIGEST:e * DIGEST], sizes[b * 8:e * 8]))
    if conv is not None:
        close()
    yield batch()


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, path, sizes): each conversation's digests and text sizes after its borrowed beginning.

    Conversation c takes the first h = crc32(c) % 9 turns of c - c % 5 in place of its own (% as the
    remainder that is never negative). Turns are in order, nulls first, turns of one number by
    digest. Only digests and sizes are shuffled.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    whole = F.concat(F.octet_length(text["role"]).cast("string"), F.lit(":"), text["role"], text["text"])
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int").alias("borrowed"),
        F.unhex(F.md5(whole.cast("binary"))).alias("digest"), F.octet_length(text["text"]).cast("bigint").alias("size"),
    )
    placed = turns.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "digest", "size")
    return placed.drop("turn").mapInArrow(_rebuild, "conv_id bigint, key binary, path binary, sizes binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids in order, by key, to one row per key: its least member, their number, the digest of their list."""
    key, state, least, n = None, hashlib.sha256(), 0, 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)],
                                          ["key", "conv_id", "n", "ends"])
        out.clear()
        return done

    for rows in batches:
        for k, c, more, listed in zip(*[rows.column(c).to_pylist() for c in ("key", "conv_id", "n", "listed")]):
            if k == key:
                n += more
                state.update(b"," + listed.encode())
                continue
            if key is not None:
                out.append((key, least, n, state.digest()))
                if len(out) == 10_000:
                    yield batch()
            key, state, least, n = k, hashlib.sha256(listed.encode()), c, more
    if key is not None:
        out.append((key, least, n, state.digest()))
    yield batch()


def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. The pair (conv_id, depth) names a node. Null roles and texts count as empty; rows
    without conv_id belong to no conversation; repeated rows are turns of their own; an empty table
    has no node. A conversation takes 24 bytes per turn in the task that reads it. Copies of a
    conversation meet only as texts of up to 4096 ids, read in order and never held. `shard_nodes` and `fan`
    bound what a task holds; they do not change the result.
    """
    spark = conversations.sparkSession
    whole = settle(rebuild(conversations), "rebuilt")
    # Ids of a run of 4096 become one text first, so that many copies meet as few rows.
    runs = whole.groupBy("key", F.shiftright("conv_id", 12).alias("run")).agg(
        F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("listed"))
    members = runs.repartition("key").sortWithinPartitions("key", "run").drop("run").mapInArrow(
        _members, "key binary, conv_id bigint, n bigint, ends binary")
    paths = whole.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    sequences = paths.join(members, "key").drop("key")
    ordered = sequences.repartitionByRange(F.substring("path", 1, RANGE_BYTES)).sortWithinPartitions("path")
    folded = settle(ordered.mapInArrow(_fold(1, False, shard_nodes), FOLDED), "trie-1")
    done = [folded]
    tasks, level = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while True:
        spines = folded.where(F.col("path").isNotNull()).select(*SPINE)
        tasks, level, last = -(-tasks // fan), level + 1, tasks <= fan
        spread = spines.repartition(1) if last else spines.repartitionByRange(tasks, "task")
        folded = settle(spread.sortWithinPartitions("task", "seq").mapInArrow(_fold(level, last, shard_nodes), FOLDED), f"trie-{level}")
        done.append(folded)
        if last:
            break
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.where(F.col("path").isNull()).select(*FINAL)
    above = done[1]
    for more in done[2:]:
        above = above.unionByName(more)
    above = above.where(F.col("key").isNotNull()).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    open_ = nodes.where(F.col("parent_key").isNotNull())
    known = lookup_join(open_, above, "parent_key", spread_by=["conv_id", "depth"]).withColumn("parent_conv_id", F.col("_above"))
    kept = [c for c in FINAL if c not in ("key", "parent_key")]
    return nodes.where(F.col("parent_key").isNull()).select(*kept).unionByName(known.select(*kept))
