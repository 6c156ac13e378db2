"""The prefix trie against a plain version, and its queue where it spills."""

import hashlib
import random
import zlib

import pytest

from metrum.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows (conv_id, turn, role, text) to the set of nodes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves = sum(sums[k][0] for k in kids) or 1
        saved = sum(sums[k][1] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, depth int, p1 string, members int")
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(table.repartition(3), **settings).collect()), key=repr)


@pytest.mark.parametrize("shard", [2, 256])
def test_random(spark, shard):
    """Many shared beginnings, with shards of two conversations (up to seven rounds) and of all at once."""
    draw = random.Random(5)
    rows = []
    for c in [*range(60), *range(100, 140), -5, -100, -203, 10_000]:
        said = [(draw.choice("ua"), draw.choice(["x", "yy", "é😀"])) for _ in range(draw.randrange(1, 9))]
        rows += [(c, k, *t) for k, t in enumerate(said)]
    assert found(spark, rows, shard=shard, held=2) == plain(rows)


def test_edges(spark):
    """Null turns, roles, texts and ids, repeated rows, gaps between turns, copies, a turnless conversation, no rows."""
    turnless = next(c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [
        (0, 5, "u", "b"), (0, None, "u", "a"), (0, 9, None, None), (0, 9, None, None), (1, 1, "", ""), (1, 2, "u", ""), (2, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, None, "a"),
        (turnless, 0, "u", "a"), (None, 0, "u", "a"), (None, None, None, None), (7, 0, "u", "long " * 20_000), (8, 0, "u", "long " * 20_000),
        *[(c, t, "u", "same") for c in range(200, 230) for t in range(3)],
    ]
    assert found(spark, rows) == plain(rows)
    assert (0, 0, None, 36) in {r[:4] for r in found(spark, rows)}
    assert found(spark, []) == []


def test_long_conversation(spark):
    """One conversation of several tiles beside a copy of its first half."""
    rows = [(c, k, "u", str(k % 7)) for c, n in ((100, 9000), (101, 4500)) for k in range(n)]
    got = {r[:2]: r for r in found(spark, rows)}
    want = {r[:2]: r for r in plain(rows)}
    assert got == want


def test_inbox():
    """Messages come back in order and in full whether or not they were spilled."""
    draw = random.Random(2)
    messages = [(draw.randrange(-50, 50), draw.randrange(20), draw.randrange(9), draw.randrange(1000)) for _ in range(5000)]
    for held in (3, 10_000):
        inbox = prefix_trie.Inbox(held)
        for m in messages:
            inbox.push(m)
        assert (inbox.spilled > 0) == (held == 3)
        for place in sorted({m[:2] for m in messages}):
            want = [m for m in messages if m[:2] == place]
            assert inbox.take(*place) == (sum(m[2] for m in want), sum(m[3] for m in want))
        assert not inbox and inbox.take(99, 0) == (0, 0)
