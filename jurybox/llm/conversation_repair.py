"""Repair of conversation structure: damaged rows, faults, the cheapest edits, the repaired text.

A conversation's role initials must read `(s?(ua)+)?`. A cost DP over (rows consumed, state of
that pattern) gives every node its cost to the end. Nodes and arcs on cheapest ways form a graph
in which each letter leads to one node, so a node's least audit begins with its least letter; the
nodes are then ranked by their audits' first 1, 2, 4, ... letters while pointers double. Start nodes
of one rank share one audit, which is read once, letter t through the pointers of t's bits.

Text never waits for a decision: the DP reads a few bytes per row, and the text is read afterwards
in order, its conversation's audit before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of the edits, and what an undeleted truncated row adds.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # by rank; 0 is the end
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role a state takes next.
NEXT = np.array([2, 2, 3, 2])
ROLE_OF = {2: "user", 3: "assistant"}
END_COST = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
# Where keeping a row leads, by its initial (s, u, a, another) and state; FAR where it can't be kept.
KEEP_TO = np.array([[1, 0, 0, 0], [2, 2, 0, 2], [0, 0, 3, 0], [0, 0, 0, 0]])
KEEP_BAR = np.array([[0, FAR, FAR, FAR], [0, 0, FAR, 0], [FAR, FAR, 0, FAR], [FAR] * 4])
BLOCK = 64  # rows of a block of the DP
ROWS_AT_ONCE = 50_000  # rows whose conversations are solved together, except for a single longer one

FACTS = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
         "cost bigint, audit string")


def _order() -> list[Column]:
    """Rows of one conversation by turn, equal rows side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes `[.!?]` from it, 3 repeats the row, 4 makes it the
    user's. Null roles, texts, ids and turns count as one space.
    """
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    role = F.when(kind == 4, "user").otherwise(_spaced("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def _with_digest(rows: DataFrame) -> DataFrame:
    """Rows without nulls in role and text, with a digest that tells rows of one turn apart."""
    plain = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return plain.withColumn("digest", F.unhex(F.md5(both.cast("binary"))))


def solve(initials: np.ndarray, faults: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least cost and least audit of conversations laid end to end.

    `initials` is 0 to 3 for s, u, a and others, `faults` 0 for none, 1 for blank, 2 for duplicate and
    3 for truncated. Every conversation is cut into blocks; a block's DP from each of the four end
    states gives its transfer costs, blocks are joined from the end, and a second DP fills them in.
    """
    n_conv, n = len(lengths), int(lengths.sum())
    blocks = -(-lengths // BLOCK)
    first_row, first_block = np.cumsum(lengths) - lengths, np.cumsum(blocks) - blocks
    n_blocks = int(blocks.sum())
    conv_of = np.repeat(np.arange(n_conv), lengths)
    inside = np.arange(n) - first_row[conv_of]
    place = (first_block[conv_of] + inside // BLOCK) * BLOCK + inside % BLOCK

    def padded(values: np.ndarray, blank: int) -> np.ndarray:
        out = np.full(n_blocks * BLOCK, blank, np.int64)
        out[place] = values
        return out.reshape(n_blocks, BLOCK)

    must = (faults == 1) | (faults == 2)
    extra = np.where(faults == 3, TRUNCATED, 0)
    kind = padded(initials, 3)
    keep = padded(np.where(must, FAR, extra), FAR)
    rerole = padded(np.where(must, FAR, extra + REROLE), FAR)
    delete = padded(np.full(n, DELETE), 0)  # rows that fill a block up cost nothing

    def step(after: np.ndarray, j: int) -> np.ndarray:
        """Costs before row j of every block from those after it; the last axis is the state."""
        lift = (slice(None), *[None] * (after.ndim - 1))
        to = np.broadcast_to(KEEP_TO[kind[:, j]].reshape(n_blocks, *[1] * (after.ndim - 2), 4), after.shape)
        bar = KEEP_BAR[kind[:, j]].reshape(n_blocks, *[1] * (after.ndim - 2), 4)
        now = np.minimum(after + delete[:, j][lift], after[..., NEXT] + rerole[:, j][lift])
        now = np.minimum(now, np.take_along_axis(after, to, -1) + bar + keep[:, j][lift])
        user = np.minimum(now[..., 2], now[..., 3] + INSERT)
        now[..., 3] = np.minimum(now[..., 3], now[..., 2] + INSERT)
        now[..., 2] = user
        now[..., :2] = np.minimum(now[..., :2], user[..., None] + INSERT)
        return np.minimum(now, FAR)

    through = np.full((n_blocks, 4, 4), FAR, np.int64)  # block, end state, begin state
    through[:, np.arange(4), np.arange(4)] = 0
    for j in range(BLOCK - 1, -1, -1):
        through = step(through, j)
    cost = np.empty((n_blocks, BLOCK + 1, 4), np.int64)
    tail = np.broadcast_to(END_COST, (n_conv, 4)).copy()
    for k in range(1, int(blocks.max(initial=0)) + 1):
        live = np.flatnonzero(blocks >= k)
        block = first_block[live] + blocks[live] - k
        cost[block, BLOCK] = tail[live]
        tail[live] = (through[block] + tail[live][:, :, None]).min(1)
    for j in range(BLOCK - 1, -1, -1):
        cost[:, j] = step(cost[:, j + 1], j)

    # Layers of nodes: a conversation's rows, then its end. The costs of the layer after each.
    layers = lengths + 1
    first_layer = np.cumsum(layers) - layers
    total = int(layers.sum())
    at_row = first_layer[conv_of] + inside
    here = np.tile(END_COST, (total, 1))
    flat = cost[:, :BLOCK].reshape(-1, 4)
    here[at_row] = flat[place]
    after = here[at_row + 1]
    node = (np.arange(total)[:, None] * 4 + np.arange(4)).astype(np.int64)
    # The least letter of the arcs on a cheapest way, and where it leads.
    rank = np.zeros((total, 4), np.int64)
    pointer = node.copy()

    def offer(letter: int, where: np.ndarray, target: np.ndarray, tight: np.ndarray) -> None:
        new = tight & (rank[where] == 0)
        rank[where] = np.where(new, letter, rank[where])
        pointer[where] = np.where(new, target, pointer[where])

    everywhere = np.arange(total)
    ended = np.zeros((total, 4), bool)
    ended[first_layer + lengths] = END_COST == 0
    to = KEEP_TO[initials]
    below = node[at_row + 1]
    offer(1, at_row, below, here[at_row] == after + DELETE)
    offer(2, everywhere, node[:, NEXT], (here == here[:, NEXT] + INSERT) & ~ended)
    kept = np.take_along_axis(after, to, -1) + KEEP_BAR[initials] + np.where(must, FAR, extra)[:, None]
    offer(3, at_row, np.take_along_axis(below, to, -1), here[at_row] == kept)
    offer(4, at_row, below[:, NEXT], here[at_row] == after[:, NEXT] + np.where(must, FAR, extra + REROLE)[:, None])

    letter, rank, pointer = rank.ravel(), rank.ravel(), pointer.ravel()
    steps = (letter > 0).astype(np.int64)
    pointers = [pointer]
    while (letter[pointer] > 0).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    start = first_layer * 4
    _, one, same = np.unique(rank[start], return_index=True, return_inverse=True)
    length = steps[start[one]]
    t = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    on = np.repeat(start[one], length)
    for k, jump in enumerate(pointers):
        on = np.where(t >> k & 1, jump[on], on)
    read = LETTERS[letter[on]].tobytes().decode()
    ends = np.cumsum(length)
    audits = [read[e - s:e] for e, s in zip(ends.tolist(), length.tolist())]
    return here[first_layer, 0], [audits[i] for i in same.tolist()]


def _facts(ids: list, lengths: np.ndarray, turns: np.ndarray, no_turn: np.ndarray, initials: np.ndarray, flags: np.ndarray,
           digests: np.ndarray) -> pa.RecordBatch:
    """Faults, gaps, cost and audit of whole conversations laid end to end."""
    conv = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    order = np.lexsort((np.arange(len(conv)), digests["b"], digests["a"], conv))
    repeat = np.zeros(len(conv), bool)
    if len(order):
        s, p = order[1:], order[:-1]
        repeat[s] = (conv[s] == conv[p]) & (digests["a"][s] == digests["a"][p]) & (digests["b"][s] == digests["b"][p])
    faults = np.where(flags & 1, 1, np.where(repeat, 2, np.where(flags & 2, 3, 0)))
    pair = conv[1:] == conv[:-1] if len(conv) else np.zeros(0, bool)
    a, b = initials[:-1], initials[1:]
    legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))

    def per_conv(hit: np.ndarray, which: np.ndarray = conv) -> np.ndarray:
        return np.bincount(which[hit], minlength=len(lengths))

    # Rows are in turn order, nulls first: turns differ where they change; null turns are left out.
    changed = np.ones(len(conv), bool)
    changed[1:] = ~pair | (turns[1:] != turns[:-1]) | no_turn[:-1]
    distinct = per_conv(changed & ~no_turn)
    nulls = per_conv(no_turn)
    some = lengths > nulls
    low = turns[np.where(some, first + nulls, 0)]
    high = turns[first + lengths - 1]
    gaps = np.where(some, high - low + 1 - distinct, 0)
    cost, audits = solve(initials, faults, lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(gaps, pa.int64()), *[pa.array(per_conv(faults == k), pa.int64()) for k in (1, 2, 3)],
         pa.array(per_conv(pair & ~legal, conv[1:]) if len(conv) else np.zeros(0), pa.int64()), pa.array(cost, pa.int64()),
         pa.array(audits, pa.string())],
        ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


DIGEST = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole conversations to one row each; the last conversation of a batch may go on in the next."""
    held: list[tuple] = []
    ids: list = []
    lengths: list[int] = []

    def flush(n_conv: int) -> pa.RecordBatch:
        nonlocal held
        parts = [np.concatenate([h[i] for h in held]) for i in range(5)]
        rows = sum(lengths[:n_conv])
        out = _facts(ids[:n_conv], np.array(lengths[:n_conv]), *[p[:rows] for p in parts])
        held = [tuple(p[rows:] for p in parts)]
        del ids[:n_conv], lengths[:n_conv]
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        turn = batch.column("turn")
        conv = batch.column("conv_id").to_pylist()
        raw = batch.column("digest")
        digest = np.frombuffer(raw.buffers()[2], np.uint8)[raw.offset * 16:(raw.offset + len(raw)) * 16].copy().view(DIGEST) \
            if isinstance(raw, pa.FixedSizeBinaryArray) else np.frombuffer(b"".join(raw.to_pylist()), DIGEST)
        held.append((turn.fill_null(0).to_numpy(), np.asarray(turn.is_null()), batch.column("initial").to_numpy(),
                     batch.column("flags").to_numpy(), digest))
        keys = np.array([-1 if c is None else c for c in conv])
        none = np.array([c is None for c in conv])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(conv)]
        for b, e in zip(bounds[:-1], bounds[1:]):
            if b == 0 and ids and ids[-1] == conv[0]:
                lengths[-1] += e
            else:
                ids.append(conv[b])
                lengths.append(e - b)
        if len(ids) > 1 and sum(lengths[:-1]) >= ROWS_AT_ONCE:
            yield flush(len(ids) - 1)
    if ids:
        yield flush(len(ids))


def diagnose(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, the least cost of a repair and its audit.

    Rows are taken by turn, nulls first, rows of one turn by role and digest, so equal rows stand side
    by side. Null roles and texts count as one space; a null conv_id is a conversation as well. Only
    initials, flags and digests are shuffled. A task holds about 50 bytes per row of its longest
    conversation. Repeated rows are faults to repair; an empty table gives an empty table.
    """
    keyed = _with_digest(rows)
    initial = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.left("role", F.lit(1))), F.lit(0))
    stripped = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    flags = F.when(stripped == "", 1).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), 2).otherwise(0)
    narrow = keyed.select(
        "conv_id", "turn", "role", "digest", F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"),
        flags.cast("int").alias("flags"))
    return narrow.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order()).drop("role").mapInArrow(_diagnose, FACTS)


def edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each line that the audit keeps, changes or inserts, in order."""
    state = 0
    for letter in audit:
        if letter == "I":
            state = int(NEXT[state])
            yield letter, ROLE_OF[state], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield letter, role, text
        elif letter == "R":
            state = int(NEXT[state])
            yield letter, ROLE_OF[state], text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """(conv_id, audit, its rows) from rows sorted with the audit first; the rows are read as they are asked for."""
    def records() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")])

    stream = records()
    current = next(stream, None)
    while current is not None:
        conv_id, audit = current[0], current[1]

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal current
            current = next(stream, None)
            while current is not None and current[1] is None:
                yield current[2], current[3]
                current = next(stream, None)

        given = rows()
        yield conv_id, audit, given
        for _ in given:  # nothing is left where the audit has a letter for each row
            pass


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, digests = [], []
    for conv_id, audit, rows in _conversations(batches):
        digest, between = hashlib.sha256(), ""
        for _, role, text in edits(audit, rows):
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        ids.append(conv_id)
        digests.append(digest.hexdigest())
        if len(ids) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], ["conv_id", "repaired_sha256"])
            ids, digests = [], []
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])


LINES = "conv_id bigint, line bigint, edit string, role string, text string"


def _write_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "line", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for conv_id, audit, rows in _conversations(batches):
        for line, (letter, role, text) in enumerate(edits(audit, rows)):
            out.append((conv_id, line, letter, role, text))
            if len(out) == 1_000:
                yield batch()
                out = []
    yield batch()


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, whole conversations to a partition."""
    texts = _with_digest(rows).withColumn("audit", F.lit(None).cast("string"))
    return (
        texts.unionByName(found.select("conv_id", "audit"), allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *_order())
        .select("conv_id", "audit", "role", "text")
    )


def repaired_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, line, edit, role, text): the repaired conversations, from `diagnose` of the same rows."""
    return _with_audits(rows, found).mapInArrow(_write_lines, LINES)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over `role:text` of the repaired lines; no text waits in memory."""
    return _with_audits(rows, found).mapInArrow(_hash_lines, "conv_id bigint, repaired_sha256 string")
