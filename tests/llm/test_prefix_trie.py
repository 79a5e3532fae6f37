"""The conversation trie against a brute-force trie, on tables cut into many shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from phylospan.llm.prefix_trie import Minima, conversation_trie, shard_nodes

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:3])] for c, x in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + own[c][h(c) :] for c in own}


def brute(rows):
    seqs = rebuilt(rows)
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    totals = {}

    def total(p):
        if p not in totals:
            below = [total(q) for q in children[p]]
            own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
            totals[p] = (sum(x for x, _ in below) or 1, own + sum(y for _, y in below))
        return totals[p]

    for p in sorted(nodes, key=len, reverse=True):
        total(p)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in conversation_trie(df, **kw).select(COLS).collect()), key=str)


def skewed(seed, n=260):
    """A third are one conversation, most begin alike, some are empty after the shared head, some are long."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        kind = rnd.random()
        length = 5 if kind < 0.35 else 60 if kind > 0.98 else rnd.randint(1, 9)
        for k in range(length):
            word = "hot" if kind < 0.35 or k < rnd.randint(0, 4) else rnd.choice(["a", "ä\U0001f600b", "", "long text"])
            rows.append((c, k, ["user", "assistant"][k % 2], word))
    return rows


@pytest.mark.parametrize("shard_bytes", [400, 4000, 1 << 22])
def test_equals_brute_force_in_any_number_of_shards(spark, shard_bytes):
    rows = skewed(shard_bytes)
    assert got(spark, rows, shard_bytes=shard_bytes) == brute(rows)


def test_nulls_ties_repeats_and_absent_heads(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "assistant", "y"), (100, 0, "user", "x"), (100, 1, "user", "x"), (105, 3, "user", "a"), (205, 0, "user", ""), (205, 1, None, ""), (300, 0, "us", "erx"), (399, 0, "user", "x"), (-5, 0, "user", "x")]
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_alone(spark):
    """Conversations whose few turns all give way to a head that is absent: the root alone, its own leaf."""
    ids = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100]
    rows = [(c, 0, "user", "x") for c in ids]
    assert got(spark, rows, shard_bytes=300) == brute(rows)
    assert len(brute(rows)) == 1


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "x", 5, b"k")], SCHEMA + ", shard int, turns binary")
    assert len(conversation_trie(df).collect()) == len(brute([(1, 0, "user", "x")]))


def test_very_long_text(spark):
    rows = [(6, k, "user", "x" * 300_000) for k in range(8)] + [(8, k, "user", "x" * 300_000) for k in range(8)]
    assert got(spark, rows) == brute(rows)


def test_sparse_table_searches_by_brute_force():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        v = rnd.integers(0, 4, n)
        v[0] = -1
        m = Minima(v)
        at, floor = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        right, left = m.reach_right(at, floor), m.reach_left(at, floor)
        for a, f, r, lo in zip(at, floor, right, left):
            assert r == next((k for k in range(a, n - 1) if v[k + 1] < f), n - 1)
            assert lo == next((k for k in range(a, 0, -1) if v[k] < f), 0)
        lo, hi = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
        assert m.least(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]


def test_a_shard_alone_has_no_open_node():
    keys = [bytes(20), bytes(40)]
    nodes, pieces = shard_nodes(keys, np.array([4, 3]), None, None)
    assert [n[0] for n in nodes] == [None] * 3 and not pieces
    assert [n[2:6] for n in nodes] == [(3, 0, None, 2), (3, 1, 3, 2), (3, 2, 3, 1)]
