"""A mergeable distinct-count sketch with three estimators, and exact distinct counts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64, murmur64
from phylospan.storage import written

#: Bits of a sparse sketch's index.
SPARSE_BITS = 25
#: Largest linear count that is taken as it is, by precision from 4 on (fixed values).
LINEAR_UP_TO = (10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000)


def _ranks(rest: np.ndarray, width: int) -> np.ndarray:
    """Position of the first set bit among the high ``width`` bits, from 1; ``width + 1`` without one."""
    top = np.zeros(len(rest), np.int64)
    value = rest >> np.uint64(64 - width)
    for shift in (32, 16, 8, 4, 2, 1):
        big = value >> np.uint64(shift) != 0
        top += np.where(big, shift, 0)
        value = np.where(big, value >> np.uint64(shift), value)
    return np.where(rest >> np.uint64(64 - width) == 0, width + 1, width - top)


@dataclass
class Sketch:
    """Counts distinct 64-bit keys.  It starts sparse (a set of 25-bit indexes with ranks) and becomes registers."""

    precision: int = 12
    observed: int = 0
    sparse: dict = field(default_factory=dict)
    registers: np.ndarray | None = None

    def add(self, keys: np.ndarray) -> Sketch:
        h = fmix64(np.asarray(keys, np.uint64) + np.uint64(1))
        self.observed += len(h)
        if self.registers is None and len(h):
            index = (h >> np.uint64(64 - SPARSE_BITS)).tolist()
            rank = _ranks(h << np.uint64(SPARSE_BITS), 64 - SPARSE_BITS).tolist()
            for i, r in zip(index, rank):
                if self.sparse.get(i, 0) < r:
                    self.sparse[i] = r
            if len(self.sparse) > (1 << self.precision) // 4:
                self._dense()
        elif len(h):
            p = self.precision
            np.maximum.at(self.registers, (h >> np.uint64(64 - p)).astype(np.int64), _ranks(h << np.uint64(p), 64 - p).astype(np.uint8))
        return self

    def _as_registers(self) -> np.ndarray:
        if self.registers is not None:
            return self.registers
        p, more = self.precision, SPARSE_BITS - self.precision
        out = np.zeros(1 << p, np.uint8)
        for i, r in self.sparse.items():
            low = i & ((1 << more) - 1)
            rank = more - low.bit_length() + 1 if low else more + r
            out[i >> more] = max(out[i >> more], rank)
        return out

    def _dense(self) -> None:
        self.registers, self.sparse = self._as_registers(), {}

    def merge(self, other: Sketch) -> Sketch:
        """Both sketches' keys; two sparse ones stay sparse."""
        if self.precision != other.precision:
            raise ValueError("sketches of different precision")
        out = Sketch(self.precision, self.observed + other.observed, dict(self.sparse))
        if self.registers is None and other.registers is None:
            for i, r in other.sparse.items():
                out.sparse[i] = max(out.sparse.get(i, 0), r)
        else:
            out.registers, out.sparse = np.maximum(self._as_registers(), other._as_registers()), {}
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.precision, self.observed, self.registers is not None], "<i8").tobytes()
        if self.registers is not None:
            return head + self.registers.tobytes()
        return head + np.array(sorted(self.sparse.items()), "<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        precision, observed, dense = np.frombuffer(data, "<i8", 3).tolist()
        if dense:
            return cls(precision, observed, {}, np.frombuffer(data, np.uint8, offset=24).copy())
        pairs = np.frombuffer(data, "<i8", offset=24).reshape(-1, 2)
        return cls(precision, observed, dict(map(tuple, pairs.tolist())))

    def _bounded(self, estimate: float) -> int:
        return self.observed if self.observed < estimate else round(estimate)

    def estimate(self) -> int:
        """The bias-free estimator with corrections for empty and for full registers."""
        if self.registers is None:
            q, m = 64 - SPARSE_BITS, 1 << SPARSE_BITS
            counts = np.bincount(list(self.sparse.values()) or [0], minlength=q + 2).astype(float)
            counts[0] = m - len(self.sparse)
        else:
            q, m = 64 - self.precision, 1 << self.precision
            counts = np.bincount(self.registers, minlength=q + 2).astype(float)
        z = m * _tau(1 - counts[q + 1] / m)
        for k in range(q, 0, -1):
            z = 0.5 * (z + counts[k])
        z += m * _sigma(counts[0] / m)
        return self._bounded(m * m / (2 * math.log(2)) / z)

    def estimate_linear(self) -> int:
        """The raw estimator, with linear counting up to 2.5 times the registers."""
        registers = self._as_registers()
        m, raw = len(registers), _raw(registers)
        empty = int((registers == 0).sum())
        return self._bounded(m * math.log(m / empty) if raw <= 2.5 * m and empty else raw)

    def estimate_corrected(self) -> int:
        """Linear counting while it is small, else the raw estimator less its mean bias."""
        if self.registers is None:
            m = 1 << SPARSE_BITS
            return round(m * math.log(m / (m - len(self.sparse))))
        m, empty = len(self.registers), int((self.registers == 0).sum())
        if empty and (linear := round(m * math.log(m / empty))) <= LINEAR_UP_TO[self.precision - 4]:
            return linear
        raw = _raw(self.registers)
        if raw <= 5 * m:
            estimates, biases = bias_curve(self.precision)
            raw -= float(np.interp(raw, estimates, biases))
        return self._bounded(raw)


def _alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def _raw(registers: np.ndarray) -> float:
    m = len(registers)
    return _alpha(m) * m * m / float(np.exp2(-registers.astype(float)).sum())


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    y, total = 1.0, x
    while True:
        x *= x
        new = total + x * y
        y += y
        if new == total:
            return total
        total = new


def _tau(x: float) -> float:
    if x in (0, 1):
        return 0.0
    y, total = 1.0, 1 - x
    while True:
        x = math.sqrt(x)
        y /= 2
        new = total - (1 - x) ** 2 * y
        if new == total:
            return total / 3
        total = new


@lru_cache(4)
def bias_curve(precision: int, points: int = 40, trials: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The raw estimator's mean value and mean bias at rising numbers of keys, by simulation with a fixed seed."""
    m, rng = 1 << precision, np.random.default_rng(precision)
    sizes = np.linspace(m // 2, 6 * m, points).astype(int)
    means = np.zeros(points)
    for _ in range(trials):
        registers, done = np.zeros(m, np.uint8), 0
        for k, n in enumerate(sizes):
            h = rng.integers(0, 1 << 64, n - done, np.uint64)
            np.maximum.at(registers, (h >> np.uint64(64 - precision)).astype(np.int64), _ranks(h << np.uint64(precision), 64 - precision).astype(np.uint8))
            done = n
            means[k] += _raw(registers) / trials
    return means, means - sizes


# --- as columns --------------------------------------------------------------------------------------
#
# A sketch table has a row ``(g, dense, slot, rank)`` for every used slot of a group's sketch: of a sparse one the
# 25-bit indexes, of a dense one the registers.  Merging is a maximum, estimating a histogram of ranks.


def _rank_of(rest: Column, width: int) -> Column:
    """Position of the first set bit among ``width`` low bits, counted from their top from 1; ``width + 1`` without one."""
    return F.when(rest == 0, F.lit(width + 1)).otherwise(F.lit(width + 1) - F.length(F.bin(rest))).cast("int")


def _slots(hashed: Column, bits: int) -> tuple[Column, Column]:
    """The slot of a hash at a precision, and its rank there."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int"), _rank_of(hashed.bitwiseAND(F.lit((1 << (64 - bits)) - 1)), 64 - bits)


def _to_register(slot: Column, rank: Column, precision: int) -> tuple[Column, Column]:
    """Register and rank there of a sparse slot and its rank."""
    more = SPARSE_BITS - precision
    low = slot.bitwiseAND(F.lit((1 << more) - 1))
    return F.shiftright(slot, more), F.when(low == 0, rank + more).otherwise(F.lit(more + 1) - F.length(F.bin(low.cast("long")))).cast("int")


def register_of(key: Column, precision: int = 12) -> tuple[Column, Column]:
    """The register of a sketch that a key falls into, and its rank there."""
    key = key.cast("long")
    return _slots(murmur64(F.when(key == F.lit((1 << 63) - 1), F.lit(-(1 << 63))).otherwise(key + 1)), precision)


def sketches(rows: DataFrame, group: str, key: str, precision: int = 12) -> tuple[DataFrame, DataFrame]:
    """``(g, dense, slot, rank)`` and ``(g, observed)`` for the keys of every group of ``rows``.

    A sketch is dense once it has more sparse slots than a quarter of its registers.  Registers of all groups are
    made by one aggregation, at most one row a register, group and task; a group whose used registers already
    exceed that quarter is dense, and only of the others, which have few slots, are sparse slots made.
    """
    following = F.when(F.col("k") == F.lit((1 << 63) - 1), F.lit(-(1 << 63))).otherwise(F.col("k") + 1)
    hashed = rows.select(F.col(group).cast("long").alias("g"), F.col(key).cast("long").alias("k")).where("g is not null and k is not null").select("g", murmur64(following).alias("h"))
    most = (1 << precision) // 4
    slot, rank = _slots(F.col("h"), precision)
    registers = written(hashed.select("g", slot.alias("slot"), rank.alias("rank")).groupBy("g", "slot").agg(F.max("rank").alias("rank"), F.count("*").alias("n")), "registers")
    totals = registers.groupBy("g").agg(F.sum("n").alias("observed"), F.count("*").alias("used"))
    few = totals.where(F.col("used") <= most).select("g")
    slot, rank = _slots(F.col("h"), SPARSE_BITS)
    sparse = written(hashed.join(few, "g", "left_semi").select("g", slot.alias("slot"), rank.alias("rank")).groupBy("g", "slot").agg(F.max("rank").alias("rank")), "sparse-slots")
    kept = sparse.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("g")
    table = registers.join(kept, "g", "left_anti").select("g", F.lit(True).alias("dense"), "slot", "rank").unionByName(sparse.join(kept, "g", "left_semi").select("g", F.lit(False).alias("dense"), "slot", "rank"))
    return table, totals.select("g", "observed")


def merged(table: DataFrame, precision: int = 12) -> DataFrame:
    """One sketch a group of ``table(g, dense, slot, rank)``, whose groups may have slots of many sketches: sparse
    ones stay sparse together, with a dense one all become registers."""
    kinds = table.groupBy("g").agg(F.max("dense").alias("to_dense"))
    both = table.join(kinds, "g")
    turned = F.col("to_dense") & ~F.col("dense")
    slot, rank = _to_register(F.col("slot"), F.col("rank"), precision)
    moved = both.select("g", F.col("to_dense").alias("dense"), F.when(turned, slot).otherwise(F.col("slot")).alias("slot"), F.when(turned, rank).otherwise(F.col("rank")).alias("rank"))
    return moved.groupBy("g", "dense", "slot").agg(F.max("rank").alias("rank"))


#: Terms of the two correction series; later ones vanish in double precision.
_TERMS = 64


def _total(term) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.lit(0.0), lambda acc, k: acc + term(k.cast("double")))


def estimates(table: DataFrame, observed: DataFrame, precision: int = 12) -> DataFrame:
    """``(g, observed, estimate, estimate_linear)`` of a sketch table: the bias-free estimator with its corrections for
    empty and for full slots, and the raw one with linear counting (of registers; sparse slots are turned into them)."""
    bits = F.when(F.col("dense"), F.lit(precision)).otherwise(F.lit(SPARSE_BITS))
    own = _figures(table, ["g", "dense"], bits, "own")
    slot, rank = _to_register(F.col("slot"), F.col("rank"), precision)
    as_registers = table.select("g", "dense", F.when(F.col("dense"), F.col("slot")).otherwise(slot).alias("slot"), F.when(F.col("dense"), F.col("rank")).otherwise(rank).alias("rank")).groupBy("g", "dense", "slot").agg(F.max("rank").alias("rank"))
    raw = _figures(as_registers, ["g", "dense"], F.lit(precision), "raw").drop("dense")
    return _estimated(own.join(raw, "g"), observed, precision)


def merged_estimates(table: DataFrame, observed: DataFrame, precision: int = 12) -> DataFrame:
    """:func:`estimates` of :func:`merged` for a ``table`` without repeated ``(g, dense, slot)``.

    What becomes of a group's slots is decided on its histograms, so no group's slots come together: one of a clade of
    everything may have as many as there are keys.
    """
    slot, rank = _to_register(F.col("slot"), F.col("rank"), precision)
    turned = table.select("g", "dense", F.when(F.col("dense"), F.col("slot")).otherwise(slot).alias("slot"), F.when(F.col("dense"), F.col("rank")).otherwise(rank).alias("rank"))
    registers = turned.groupBy("g", "slot").agg(F.max("rank").alias("rank"), F.max("dense").alias("dense"))
    kinds = registers.groupBy("g").agg(F.max("dense").alias("dense"))
    raw = _figures(registers, ["g"], F.lit(precision), "raw")
    sparse = _figures(table.where("not dense"), ["g"], F.lit(SPARSE_BITS), "sparse")
    both = raw.join(kinds, "g").join(sparse, "g", "left")
    own = [F.when(F.col("dense"), F.col(f"{c}_raw")).otherwise(F.col(f"{c}_sparse")).alias(f"{c}_own") for c in ("used", "sum", "full", "all")]
    return _estimated(both.select("g", "dense", *[f"{c}_raw" for c in ("used", "sum", "full", "all")], *own), observed, precision)


def _figures(slots: DataFrame, key: list[str], bits: Column, name: str) -> DataFrame:
    """What estimators need of the ranks of every key's slots."""
    counts = slots.groupBy(*key, "rank").agg(F.count("*").alias("n"))
    q = F.lit(64) - bits
    weight = F.col("n") * F.pow(F.lit(2.0), -F.col("rank").cast("double"))
    return counts.groupBy(*key).agg(F.sum("n").alias(f"used_{name}"), F.sum(F.when(F.col("rank") <= q, weight).otherwise(0.0)).alias(f"sum_{name}"), F.sum(F.when(F.col("rank") > q, F.col("n")).otherwise(0)).alias(f"full_{name}"), F.sum(weight).alias(f"all_{name}"))


def _estimated(figures: DataFrame, observed: DataFrame, precision: int) -> DataFrame:
    bits = F.when(F.col("dense"), F.lit(precision)).otherwise(F.lit(SPARSE_BITS))
    m = F.pow(F.lit(2.0), bits.cast("double"))
    empty, full = (m - F.col("used_own")) / m, F.lit(1.0) - F.col("full_own") / m
    sigma = empty + _total(lambda k: F.pow(empty, F.pow(F.lit(2.0), k)) * F.pow(F.lit(2.0), k - 1))
    tau = F.when((full == 0) | (full == 1), F.lit(0.0)).otherwise((F.lit(1.0) - full - _total(lambda k: F.pow(F.lit(1.0) - F.pow(full, F.pow(F.lit(2.0), -k)), F.lit(2.0)) * F.pow(F.lit(2.0), -k))) / 3)
    z = m * tau * F.pow(F.lit(2.0), bits.cast("double") - 64) + F.col("sum_own") + m * sigma
    estimate = m * m / (2 * math.log(2)) / z
    size = float(1 << precision)
    harmonic = F.lit(_alpha(1 << precision) * size * size) / (F.col("all_raw") + F.lit(size) - F.col("used_raw"))
    free = F.lit(size) - F.col("used_raw")
    linear = F.when((harmonic <= 2.5 * size) & (free > 0), size * F.log(F.lit(size) / free)).otherwise(harmonic)
    bounded = lambda e: F.when(F.col("observed") < e, F.col("observed")).otherwise(F.round(e).cast("long"))
    return figures.join(observed, "g").select("g", "observed", bounded(estimate).alias("estimate"), bounded(linear).alias("estimate_linear"))


def exact_distinct(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``(g, observed, distinct_keys)`` per group, exactly: keys are combined before they move."""
    return rows.groupBy(F.col(group).alias("g"), F.col(key).alias("k")).agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("observed"), F.count("*").alias("distinct_keys"))
