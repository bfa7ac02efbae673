"""Operators on conversations against plain Python: the prefix trie and the repair of structure."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from jurybox.llm import conversation_repair, prefix_trie

INT = pa.int64()


@pytest.fixture
def talks(table):
    """Conversations from (conv_id, turn, role, text), with columns whose names the operators use themselves."""

    def make(rows):
        columns = list(zip(*rows)) or [()] * 4
        n = len(rows)
        return table(
            {"conv_id": INT, "turn": INT, "role": pa.string(), "text": pa.string(), "key": INT, "path": INT, "audit": INT, "digest": INT, "kind": INT},
            **dict(zip(("conv_id", "turn", "role", "text"), columns)), key=[1] * n, path=[2] * n, audit=[3] * n, digest=[4] * n, kind=[5] * n)

    return make


def plain_trie(rows):
    def place(r):
        body = f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}"
        return (r[1] is not None, r[1] or 0, hashlib.md5(body.encode()).digest())

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=place):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, len(whole) == d))
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        kids = [below(k) for k in children.get(key, [])]
        saved = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        return (sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids))

    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        out.append((min(members)[0], len(key), min(nodes[key[:-1]])[0] if key else None, len(members), len(children.get(key, [])), *below(key),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_of(df, **options):
    rows = prefix_trie.prefix_trie(df, **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[:2])


def some_talks(n, seed, texts="ab", longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # a missing conversation, some of them heads of their family
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, ("user", "assistant")[t % 2], "x" * t + rng.choice(texts)))
    return rows


@pytest.mark.parametrize("shard_nodes, fan, partitions", [(1 << 17, 256, 4), (6, 2, 4), (1, 2, 9)])
def test_trie(spark, talks, shard_nodes, fan, partitions):
    rows = some_talks(150, 3) + [(1000 + k, t, "user", f"copy {t}") for k in range(0, 60, 5) for t in range(9)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(talks(rows).repartition(5), shard_nodes=shard_nodes, fan=fan) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_nulls_ties_repeats_and_long(talks):
    rows = [
        (0, None, None, None), (0, 1, "user", None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (None, 0, "user", "lost"),
        (5, None, "", ""), (5, 1, "user", "é"), (6, 0, "user", "only"), (9, 2, "", ""), (13, 0, "u", "no head"), (14, 0, "u", "no head"),
    ] + [(20 + k, t, "user", str(t)) for k in (0, 1) for t in range(300)]
    assert trie_of(talks(rows), shard_nodes=50) == plain_trie(rows)


def test_trie_of_nothing(talks):
    assert trie_of(talks([])) == []
    assert trie_of(talks([(None, 1, "user", "a")])) == []


def test_parentheses():
    rng = random.Random(5)
    for n in (1, 2, 63, 64, 500, 3000):
        bits, open_ = [], 0
        left = n
        while left or open_:
            if left and (not open_ or rng.random() < rng.choice((0.5, 0.95))):
                bits.append(1)
                left, open_ = left - 1, open_ + 1
            else:
                bits.append(0)
                open_ -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(np.array(bits))
        assert prefix_trie.Parentheses(np.array(bits, bool)).find_close(opens).tolist() == [close[i] for i in opens.tolist()]


def test_common_turns():
    a = bytes(range(256)) * 16
    for depth in (0, 1, 2, 3, 100, 255, 256):
        b = a[:depth * 16] + b"\xff" * (len(a) - depth * 16)
        assert prefix_trie.common_turns(a, b) == depth
        assert prefix_trie.common_turns(a, a[:depth * 16]) == depth


# ---- repair --------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """All ways over (rows consumed, state), the least (cost, audit, lines) of each."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def order(r):
        body = f"{len(r[2].encode())}:{r[2]}{r[3]}"
        return (r[1] is not None, r[1] or 0, r[2], hashlib.md5(body.encode()).digest())

    result = {}
    for conv in {r[0] for r in rows}:
        kept = sorted((r for r in damaged(rows) if r[0] == conv), key=order)
        if not kept:
            result[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        faults, seen = [], set()
        for _, _, role, text in kept:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))

        def insert(best):
            for _ in range(3):
                for s, (cost, audit, lines) in list(best.items()):
                    t = step[s]
                    way = (cost + 5, audit + "I", lines + [("user:" if t == 2 else "assistant:")])
                    if t not in best or way < best[t]:
                        best[t] = way
            return best

        best = insert({0: (0, "", [])})
        for (_, _, role, text), fault in zip(kept, faults):
            new = {}
            for s, (cost, audit, lines) in best.items():
                ways = [(s, cost + 2, "D", None)]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                    if to:
                        ways.append((to, cost + more, "K", f"{role}:{text}"))
                    ways.append((step[s], cost + more + 1, "R", ("user:" if step[s] == 2 else "assistant:") + text))
                for t, c, letter, line in ways:
                    way = (c, audit + letter, lines + ([line] if line is not None else []))
                    if t not in new or way < new[t]:
                        new[t] = way
            best = insert(new)
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        turns = [r[1] for r in kept if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        result[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def repair(df):
    rows = conversation_repair.damage(df)
    found = conversation_repair.diagnose(rows)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.repaired_digests(rows, found).collect()}
    facts = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    lines = {}
    for r in conversation_repair.repaired_lines(rows, found).orderBy("line").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, digest in hashes.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest
    return {c: (*facts[c], hashes[c]) for c in facts}


def test_repair(talks):
    rng = random.Random(9)
    rows = [
        (c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
         rng.choice(["One.", "Two!", "three", " ", "Four? ", "One.", None, f"text {t}."]))
        for c in range(120) for t in range(rng.choice([1, 2, 4, 8, 70]))
    ] + [(None, t, "user", "orphan.") for t in range(3)]
    want = plain_repair(rows)
    got = repair(talks(rows).repartition(3))
    assert got == {c: v for c, v in want.items() if c in got}
    assert all(want[c][6] == "" for c in want if c not in got)


def test_repair_of_long_and_regular(talks):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    assert repair(talks(rows)) == plain_repair(rows)
    assert repair(talks([])) == {}


def test_costs_and_audits():
    def solved(text, faults=None):
        initials = np.array(["sua".find(c) if c in "sua" else 3 for c in text])
        cost, audits = conversation_repair.solve(initials, np.array(faults or [0] * len(text)), np.array([len(text)]))
        return int(cost[0]), audits[0]

    assert solved("sua") == (0, "KKK")
    assert solved("uu") == (1, "KR")
    assert solved("u") == (2, "D")
    assert solved("aua") == (2, "DKK")
    assert solved("ux" + "a" * 2, [0, 1, 0, 0])[0] == 4
    assert solved("uaua", [0, 3, 0, 0]) == (4, "DDKK")  # before KDDK by ASCII
