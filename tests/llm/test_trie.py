"""The prefix trie against plain Python, and its searches on long and odd conversations."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from strikeloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows, group=None):
    """Nodes of (conv_id, turn, role, text) rows, one dictionary entry a prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(x[1], x[3]) for x in sorted(said)] for c, said in own.items()}
    if group:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        leader = {c: c - (c % group if c >= 0 else -(-c % group)) for c in own}
        own = {c: own.get(leader[c], [])[: cut[c]] + said[cut[c] :] for c, said in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        ends[tuple(own[c])].append(c)
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    return {
        (m[0], len(node)): (members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, m in members.items()
    }


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("group", [None, 5])
def test_all_conversations(spark, sf, group):
    turns = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert nodes(prefixtrie.prefix_trie(turns, group)) == by_hand(rows, group)


def test_odd_rows(spark):
    rows = [
        (3, None, "user", "first"), (3, 1, None, None), (3, 1, "user", "b"), (3, 1, "user", "b"), (4, 0, "", "é"), (4, 2, "user", None),
        (None, 1, "user", "lost"), (-4, 0, "user", "x"), (-5, 0, "user", "x"), (-5, 1, "user", "y"), (7, 0, "a:1", "b"), (8, 0, "a", ":1b"), (9, 0, "user", "first"),
    ]
    df = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(rows)], SCHEMA + ", prefix long, depth long").withColumnRenamed("prefix", "a.b")
    for group in (None, 5):
        assert nodes(prefixtrie.prefix_trie(df, group)) == by_hand(rows, group)
    assert prefixtrie.prefix_trie(df.limit(0), 5).count() == 0
    one = nodes(prefixtrie.prefix_trie(df.filter("conv_id = 9"), 5))
    assert one == by_hand([rows[-1]], 5)


def test_long_chains_and_copies(spark, monkeypatch):
    """Conversations of several blocks and stretches, a tall tree, many ends at one node, hot prefixes."""
    monkeypatch.setattr(prefixtrie, "STRETCH", 16)
    monkeypatch.setattr(prefixtrie, "BLOCK", 8)
    monkeypatch.setattr(prefixtrie, "SHARE", 1)
    said = lambda c, n: [(c, t, "user", f"turn {t}") for t in range(n)]
    rows = said(0, 70) + said(1, 70) + said(2, 64) + said(3, 8)
    for c in range(4, 40):  # each leaves the one before a turn later
        rows += [(c, t, "user", f"turn {t}" if t < 3 else f"step {min(t, c)}") for t in range(c + 1)]
    rows += [(100 + c, 0, "user", "same") for c in range(1500)] + [(5000, 0, "user", "é" * 300_000), (5001, 0, "user", "é" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for group in (None, 5):
        assert nodes(prefixtrie.prefix_trie(df, group)) == by_hand(rows, group)


def test_same_as_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = prefixtrie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"), 5)
    want = duck.sql(prefixtrie.SQL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.project(", ".join(got.columns)).fetchall(), key=str)
