"""Hashing and bit arithmetic, on numpy arrays and as Spark columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 64-bit finalizer's multipliers (fixed values).
FIRST, SECOND = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Parts of the hash range that a capacity estimate counts in (fixed value).
SECTIONS = 1024


def fmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of an unsigned array."""
    x = np.asarray(x, np.uint64)
    s = np.uint64(33)
    x = (x ^ (x >> s)) * np.uint64(FIRST)
    x = (x ^ (x >> s)) * np.uint64(SECOND)
    return x ^ (x >> s)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _times(x: Column, factor: int) -> Column:
    """The low 64 bits of a product, in limbs of 16 bits: no step overflows, so ANSI mode does not mind."""
    a = [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    c = [(factor >> 16 * k) & 0xFFFF for k in range(4)]
    total, out = None, None
    for k in range(4):
        part = sum((a[i] * F.lit(c[k - i]) for i in range(1, k + 1)), a[0] * F.lit(c[k]))
        total = part if total is None else part + F.shiftrightunsigned(total, 16)
        limb = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF)), 16 * k)
        out = limb if out is None else out.bitwiseOR(limb)
    return out


def murmur64(x: Column) -> Column:
    """:func:`fmix64` of a BIGINT column, as the BIGINT with the same bits."""
    fold = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33))
    first = bind(fold(x.cast("long")), lambda v: _times(v, FIRST))
    second = bind(bind(first, fold), lambda v: _times(v, SECOND))
    return bind(second, fold)


def unsigned_less(a: Column, b: Column) -> Column:
    """Whether BIGINT ``a`` is less than ``b`` as unsigned numbers."""
    low = F.lit(-(1 << 63)).cast("long")
    return a.bitwiseXOR(low) < b.bitwiseXOR(low)


def signed(x: int) -> int:
    """The BIGINT with the bits of an unsigned number."""
    return x - (1 << 64) if x >> 63 else x


def reverse_complement(x: int, n: int, version: int = 1) -> int:
    """The reverse complement of an ``n``-mer of two-bit codes; version 0 keeps the complement's high end."""
    out = 0
    for _ in range(32):
        out = out << 2 | (x & 3)
        x >>= 2
    out = ~out & ((1 << 64) - 1)
    return (out if version == 0 else out >> (64 - 2 * n)) & ((1 << 2 * n) - 1)


def expand_mask(mask: str, factor: int) -> str:
    """Every digit of a seed mask repeated ``factor`` times."""
    return "".join(c * factor for c in mask)


def mask_string(mask: int, digits: int = 64) -> str:
    """The low ``digits`` bits of a mask."""
    return f"{mask & ((1 << digits) - 1):0{digits}b}"


def bits_for_taxa(node_count: int, requested: int = 0) -> int:
    """Value bits that hold a node number: the least that do, or more if requested."""
    need = 1
    while 1 << need < node_count:
        need += 1
    if 0 < requested < need:
        raise ValueError(f"{requested} bits cannot hold {node_count} nodes")
    return max(need, requested)


def subsample_threshold(maximum: int, capacity: int) -> int:
    """The unsigned hash below which minimizers are left out so that about ``maximum`` of ``capacity`` stay."""
    if maximum > capacity:
        raise ValueError("the maximum exceeds the capacity")
    x = (1.0 - maximum / capacity) * math.ldexp(1.0, 64)
    return min((1 << 64) - 1, max(0, int(x)))
