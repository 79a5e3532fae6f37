"""Hashing, bits and the minimizer scan, against known vectors and a step-by-step model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospan.functions import bits
from phylospan.model import IndexOptions
from phylospan.operators.minimizers import PROTEIN_GROUPS, minimizer_tokens, minimizers, runs, tokens, window_least

VECTORS = {0: 0, 1: 12994781566227106604, 2: 4233148493373801447, 42: 9297814886316923340, 255: 1297215527019907880, 256: 15401116602503760187, 1000: 12610127409379334721, (1 << 64) - 1: 7256831767414464289, (1 << 64) - 2: 4216938840244723755, 0xDEADBEEF: 15153440252345589164, 0xCAFEBABE: 987948222317082758, 0x123456789ABCDEF0: 1781385183907554200}


def model_tokens(seq, o):
    """Base by base: a window of candidates, cleared by an ambiguous base."""
    codes = {c: k for k, g in enumerate("ACGT" if o.dna else PROTEIN_GROUPS) for c in g + g.lower()}
    out, since, window = [], None, []
    low = -1
    for e in range(1, len(seq) + 1):
        if seq[e - 1] not in codes:
            low, window = e - 1, []
        lmer = seq[max(0, e - o.l) : e]
        if len(lmer) == o.l and all(c in codes for c in lmer):
            x = 0
            for c in lmer:
                x = x << o.bits | codes[c]
            if o.dna:
                x = min(x, bits.reverse_complement(x, o.l, o.revcom_version))
            if o.spaced_seed_mask:
                x &= o.spaced_seed_mask
            window.append((e - o.l, x ^ o.toggle))
        window = [w for w in window if w[0] >= e - o.k]
        if e >= o.k:
            after = e - 1 - low
            ambiguous = low >= 0 and after < (o.k - 1 if o.k > o.l else o.k)
            out.append((None if ambiguous else min(w[1] for w in window) ^ o.toggle, ambiguous))
    return out


def test_murmur_vectors(spark):
    keys = np.array(list(VECTORS), np.uint64)
    assert bits.fmix64(keys).tolist() == list(VECTORS.values())
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long")
    got = {r.k: r.h for r in df.select("k", bits.murmur64(F.col("k")).alias("h")).collect()}
    assert all(got[bits.signed(k)] == bits.signed(h) for k, h in VECTORS.items())
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 500, np.uint64)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "k long")
    assert [r.h for r in df.select(bits.murmur64(F.col("k")).alias("h")).collect()] == bits.fmix64(x).view(np.int64).tolist()


def test_unsigned_less(spark):
    df = spark.createDataFrame([(1, 2), (-1, 2), (2, -1), (-2, -1), (3, 3)], "a long, b long")
    assert [r[0] for r in df.select(bits.unsigned_less(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]


def test_masks_and_thresholds():
    assert bits.expand_mask("010110", 2) == "001100111100"
    assert bits.expand_mask("1111", 3) == "1" * 12
    assert bits.expand_mask("111000", 2) == "111111000000"
    assert bits.mask_string(5, 8) == "00000101"
    assert [bits.bits_for_taxa(n) for n in (1, 2, 3, 4, 5, 1025)] == [1, 1, 2, 2, 3, 11]
    assert bits.bits_for_taxa(3, 9) == 9
    with pytest.raises(ValueError):
        bits.bits_for_taxa(100, 3)
    assert bits.subsample_threshold(5, 5) == 0 and bits.subsample_threshold(1, 2) == 1 << 63
    assert bits.reverse_complement(0b00011011, 4) == 0b00011011
    with pytest.raises(ValueError):
        IndexOptions(k=5, l=6)
    with pytest.raises(ValueError):
        IndexOptions(k=20, l=16, dna=False)


def test_known_minimizers():
    o = IndexOptions(k=10, l=5)
    m, ambiguous = tokens(b"ACGATCGACGACG", o)
    assert [hex(x) for x in m.tolist()] == ["0x2d8", "0x218", "0x218", "0x218"] and not ambiguous.any()
    assert len(tokens(b"ACGT" * 10, o)[0]) == 31 == len(tokens(b"ACGT" * 10, IndexOptions(k=10, l=10))[0])
    assert len(set(tokens(b"A" * 37, o)[0].tolist())) == 1
    flags = tokens(b"NNNNN" + b"ACGTTGCA" * 5, o)[1]
    assert flags[0] and not flags[9:].any()
    seq = bytearray("".join(random.Random(1).choices("ACGT", k=300)).encode())
    seq[150] = ord("N")
    assert tokens(bytes(seq), IndexOptions())[1].sum() == 34
    assert len(tokens(b"ACG", o)[0]) == 0 and len(tokens(b"", o)[0]) == 0


@pytest.mark.parametrize("o", [IndexOptions(k=7, l=4), IndexOptions(k=6, l=6, toggle_mask=0), IndexOptions(k=12, l=5, spaced_seed_mask=0b1100111100), IndexOptions(k=6, l=3, dna=False), IndexOptions(k=8, l=5, revcom_version=0)])
def test_scan_equals_the_model(o):
    rng = random.Random(2)
    letters = "ACGTacgtN" if o.dna else "ACDEFGHIKLMNPQRSTVWY*xBZ"
    for _ in range(300):
        seq = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        m, ambiguous = tokens(seq.encode(), o)
        assert [(None if a else v, a) for v, a in zip(m.tolist(), ambiguous.tolist())] == model_tokens(seq, o)
        rm, ra, fresh, n = runs(seq.encode(), o)
        assert n.sum() == len(m)
        clear = [v for v, a in model_tokens(seq, o) if not a]
        assert fresh.sum() == sum(1 for k, v in enumerate(clear) if not k or clear[k - 1] != v)


def test_window_least():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for w in range(1, 8):
        assert window_least(x, w).tolist() == [min(x[k : k + w]) for k in range(len(x) - w + 1)]


def test_plain_columns_equal_the_scan(spark):
    rng = random.Random(3)
    for o in (IndexOptions(k=9, l=5), IndexOptions(k=5, l=5, spaced_seed_mask=0b1111001111), IndexOptions(k=6, l=4, dna=False)):
        letters = "ACGTacgN" if o.dna else "ACDEFGHIKLMNPQRSTVWYx"
        rows = [(k, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for k in range(60)]
        df = spark.createDataFrame(rows, "seq_no long, seq string")
        got = sorted((r.read, r.pos, r.minimizer, r.ambiguous) for r in minimizer_tokens(df, o).collect())
        want = sorted((k, p, v, a) for k, s in rows for p, (v, a) in enumerate(model_tokens(s, o)))
        assert [(a, b, c is None, c or 0, d) for a, b, c, d in got] == [(a, b, c is None, c or 0, d) for a, b, c, d in want]
        distinct = {(r.read, r.minimizer) for r in minimizers(df, o).collect()}
        assert distinct == {(k, v) for k, _, v, a in want if not a}
