"""Depth-first numbers against climbing parents step by step."""

import random

import numpy as np
import pytest

from phylospan.operators.taxonomy import Taxonomy, ancestor_paths, lca_by, lca_by_closure, number, ranked
from phylospan.operators.tree import BLOCK, Tree


def random_tree(n, seed, reach=None):
    """Parents of nodes ``1 .. n`` (breadth-first or not) and their depth-first numbers."""
    rng = random.Random(seed)
    parent = [0, 0] + [rng.randint(max(1, v - reach) if reach else 1, v - 1) for v in range(2, n + 1)]
    kids = {}
    for v in range(2, n + 1):
        kids.setdefault(parent[v], []).append(v)
    entry, last, clock, stack = [0] * (n + 1), [0] * (n + 1), 0, [(1, False)]
    while stack:
        v, done = stack.pop()
        if done:
            last[v] = clock
            continue
        clock += 1
        entry[v] = clock
        stack.append((v, True))
        stack += [(c, False) for c in kids.get(v, [])]
    rows = np.arange(1, n + 1)
    return parent, Tree.of(rows, np.array(parent[1:]), np.array(entry[1:]), np.array(last[1:]), 1000 + rows)


def path(parent, v):
    out = []
    while v:
        out.append(v)
        v = parent[v]
    return out[::-1]


@pytest.mark.parametrize("n, reach", [(1, None), (2, None), (BLOCK - 1, 2), (BLOCK, None), (BLOCK + 1, 1), (5 * BLOCK + 3, 3), (40 * BLOCK, None), (700, 1)])
def test_lca_of_pairs(n, reach):
    parent, tree = random_tree(n, n, reach)
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, n + 1, 2000), rng.integers(0, n + 1, 2000)
    got = tree.node[tree.lca(tree.entry[a], tree.entry[b])]
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
        if not x or not y:
            assert z == x or z == y and not x
        else:
            assert z == [p for p, q in zip(path(parent, x), path(parent, y)) if p == q][-1]


def test_calls_of_groups():
    rng = random.Random(2)
    for trial in range(60):
        n = rng.choice([1, 3, 20, 200])
        parent, tree = random_tree(n, trial, rng.choice([None, 2]))
        groups = [{rng.randint(1, n): rng.randint(1, 4) for _ in range(rng.randint(0, 6))} for _ in range(30)]
        need = [rng.randint(0, 8) for _ in groups]
        rows = [(g, tree.entry[t], k) for g, hits in enumerate(groups) for t, k in hits.items()]
        rng.shuffle(rows)
        got = tree.node[tree.resolve(*(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], []))), np.array(need))]
        for g, hits in enumerate(groups):
            call = 0
            if hits:
                score = {t: sum(hits.get(a, 0) for a in path(parent, t)) for t in hits}
                best = [t for t in hits if score[t] == max(score.values())]
                shared = set(path(parent, best[0])).intersection(*(path(parent, t) for t in best))
                call = max(shared, key=lambda v: len(path(parent, v)))
                while call and need[g] and sum(k for t, k in hits.items() if call in path(parent, t)) < need[g]:
                    call = parent[call]
            assert got[g] == call


def test_at_most_24_bytes_a_node():
    _, tree = random_tree(5000, 1)
    assert tree.nbytes <= 24 * 5001
    again = Tree.__new__(Tree)
    again.__setstate__(tree.__getstate__())
    assert (again.node == tree.node).all()


def chain(n):
    return [(k, k - 1, f"n{k}", "") for k in range(1, n + 1)]


NODES = "ext_id long, parent_ext long, name string, rank string"


def test_a_deep_chain_is_numbered(spark):
    """Deeper than any fixed number of levels; paths come in rounds that follow the logarithm of the depth."""
    nodes = number(spark.createDataFrame(chain(300), NODES)).orderBy("node").collect()
    assert [(r.node, r.parent, r.depth, r.entry, r.last, len(r.path)) for r in nodes] == [(k, k - 1, k - 1, k, 300, k) for k in range(1, 301)]


def test_paths_end_at_dangling_parents_and_go_round_in_cycles(spark):
    rows = [(1, 1, "r", ""), (5, 1, "a", ""), (6, 5, "b", ""), (7, 99, "c", ""), (8, 7, "d", ""), (10, 12, "x", ""), (11, 10, "y", ""), (12, 11, "z", ""), (13, 12, "hangs on it", "")]
    got = {r.ext_id: (r.path, r.open) for r in ancestor_paths(spark.createDataFrame(rows, NODES)).collect()}
    assert {k: v for k, v in got.items() if not v[1]} == {1: ([1], False), 5: ([1, 5], False), 6: ([1, 5, 6], False), 7: ([7], False), 8: ([7, 8], False)}
    assert all(set(got[k][0]) >= {10, 11, 12} for k in (10, 11, 12, 13))


def test_lca_by_equals_the_closure(spark):
    rng = random.Random(9)
    rows = [(1, 0, "r", "")] + [(k, rng.randint(1, k - 1), f"n{k}", "") for k in range(2, 80)]
    taxonomy = Taxonomy.from_nodes(spark.createDataFrame(rows, NODES))
    groups = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 79)) for _ in range(300)], "g long, taxon long")
    assert sorted(map(tuple, lca_by(groups, ["g"], taxonomy).collect())) == sorted(map(tuple, lca_by_closure(groups, ["g"], taxonomy).collect()))
    odd = taxonomy.lca_pairs(spark.createDataFrame([(0, 0), (500, 3), (None, 3), (0, 7)], "a long, b long"))
    assert {(r.a, r.b): r.lca for r in odd.collect()} == {(0, 0): 0, (500, 3): None, (None, 3): None, (0, 7): 7}


def test_ranks_count_on_over_tasks(spark):
    rng = random.Random(1)
    rows = [(k, rng.random()) for k in range(1000)]
    got = ranked(spark.createDataFrame(rows, "k long, x double").repartition(7), ["x"], "place").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == [k for k, _ in sorted(rows, key=lambda r: r[1])]
    assert sorted(r.place for r in got) == list(range(1, 1001))
