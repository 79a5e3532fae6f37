"""Hard negatives against brute force in whole numbers."""

import numpy as np
import pytest

from phylospan.llm import negatives
from phylospan.llm.negatives import Block, fit_references, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    part = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) or not np.isfinite(256.0 * x) for x in vector):
            continue
        part.append((vec_id, [int(np.floor(256.0 * x)) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, qa, la) in enumerate(part):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(qa, qb)), b, lb == la) for j, (b, qb, lb) in enumerate(part) if i != j and len(qa) == len(qb)]
        scored = [s for s in scored if -(1 << 63) <= -s[0] < 1 << 63]
        for p, pid, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(a, pid, k + 1, b, -p, -s) for k, (s, b, _) in enumerate(fits)]
    return sorted(out)


def got(spark, rows):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def clustered(seed, n=900, dim=12, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((9, dim))
    return [(int(i), [float(x) for x in centres[i % 9] + spread * rnd.standard_normal(dim)], int(rnd.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("rows_in_a_slice, anchors_in_a_block", [(64, 2), (8192, 8192)])
def test_equals_brute_force(spark, monkeypatch, rows_in_a_slice, anchors_in_a_block):
    monkeypatch.setattr(negatives, "ROWS", rows_in_a_slice)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_in_a_block)
    rows = clustered(5)
    assert got(spark, rows) == brute(rows) and len(brute(rows)) > 300


def test_ties_by_id(spark):
    """A third of the rows are one vector, so most scores are equal."""
    rows = [(i, [1.0, 0.5, 0.0] if i % 3 else [0.4, 0.1, 0.0], i % 4) for i in range(330)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(6, 120, 3) + [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (300, [1.0, None, 1.0], 1), (400, [nan, 1.0, 1.0], 1), (500, [inf, 1.0, 1.0], 1), (600, [1.0, 1.0, 1.0], None), (700, [0.0, 0.0, 0.0], 2), (800, [], 1), (801, [], 2), (802, [], 1), (900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [0.5, 1.0], 3), (1000, [1e300, 1.0, 0.0], 4), (1001, [1e308, 1.0, 0.0], 4), (1100, [3e7, 1.0, 0.0], 4), (1101, [3e7, 2.0, 0.0], 4), (1102, [2e7, 1.0, 0.0], 5), (1200, [-1.0, -1.0, -1.0], 5)]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_are_other_rows(spark):
    rows = [(0, [1.0, 0.2], 3), (0, [1.0, 0.2], 3), (5, [0.5, 0.5], 1), (5, [0.5, 0.5], 1), (6, [0.6, 0.1], 4)]
    assert got(spark, rows) == brute(rows) and brute(rows)


def test_empty_and_clashing_columns(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in clustered(7, 150, 4)], SCHEMA + ", row int, norm double, dim string")
    assert sorted(tuple(r) for r in hard_negatives(df).collect()) == brute(clustered(7, 150, 4))


def test_windows_hold_every_row_that_fits_and_leave_others_out():
    """By brute force over scores; with close clusters most rows are never scored."""
    rnd = np.random.default_rng(1)
    centres = 300 * rnd.standard_normal((20, 16))
    q = np.floor(centres[rnd.integers(0, 20, 2000)] + 20 * rnd.standard_normal((2000, 16)))
    norm = np.linalg.norm(q, axis=1)
    refs = fit_references(q[:500])
    theta = np.arccos(np.clip(q @ refs.T / norm[:, None], -1, 1))
    zero = np.zeros(2000, np.int64)
    block = Block(q, norm, theta, zero, zero, zero)
    seen = 0
    for k in range(0, 2000, 40):
        score = q @ q[k]
        for low, high in ((0.7 * norm[k] ** 2, np.inf), (0.3 * norm[k] ** 2, 0.9 * norm[k] ** 2), (-np.inf, 0.0), (-0.5 * norm[k] ** 2, -0.2 * norm[k] ** 2)):
            at = np.arange(2000)[block.window(theta[k], float(norm[k]), float(low), float(high))]
            assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(at.tolist())
            seen += len(at) if high == np.inf else 0
    assert seen < 0.4 * 50 * 2000
