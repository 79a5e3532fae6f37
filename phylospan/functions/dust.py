"""Symmetric DUST: intervals of low complexity in DNA, and their masking.

A stretch of bases scores the number of pairs of equal triplets over the number of triplets less one.  It is
masked if it is perfect: over the threshold, and no part of it scores higher.  Stretches are at most a
window long; each run of A, C, G, T (U counts as T) is looked at by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.shipping import ship

WINDOW, THRESHOLD = 64, 20
_OTHER = 4
_codes = np.full(256, _OTHER, np.uint8)
for _k, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _codes[[ord(c) for c in _letters]] = _k


#: Starts that are looked at together; each stretch of them reads a window more behind its end.
STRETCH = 1 << 16


def low_complexity(text: np.ndarray, borders: np.ndarray | None = None, window: int = WINDOW, threshold: int = THRESHOLD) -> np.ndarray:
    """Which bases of ``text`` (bytes) lie in perfect intervals; none of these crosses a byte that is no base or a border.

    All starts grow together, triplet by triplet: the equal pairs of a stretch are those of the one without its first
    triplet and those that this triplet has, and the best score inside it is that of its two stretches without an end.
    """
    out, limit = np.zeros(len(text), bool), window - 2
    borders = np.empty(0, np.int64) if borders is None else np.asarray(borders, np.int64)
    for lo in range(0, len(text) - 2, STRETCH):
        part = text[lo : lo + STRETCH + limit + 1]
        near = borders[np.searchsorted(borders, lo, "right") : np.searchsorted(borders, lo + len(part))] - lo
        ends = _reach(_codes[part], near, limit, threshold)[:STRETCH]
        found = np.zeros(len(part), np.int32)
        found[: len(ends)] = np.where(ends > 0, ends + np.arange(len(ends), dtype=np.int32), 0)
        out[lo : lo + len(part)] |= np.maximum.accumulate(found) > np.arange(len(part))
    return out


def _reach(code: np.ndarray, borders: np.ndarray, limit: int, threshold: int) -> np.ndarray:
    """Bases of the longest perfect interval from every triplet on, 0 where there is none.

    Scores are quotients; those of unequal value differ by more than the type's rounding, equal ones are rounded alike.
    """
    m = len(code) - 2
    good = code < _OTHER
    valid = good[:-2] & good[1:-1] & good[2:]
    for back in (1, 2):
        at = borders - back
        valid[at[(at >= 0) & (at < m)]] = False
    at = np.arange(m, dtype=np.int32)
    room = np.minimum(np.minimum.accumulate(np.where(valid, m, at)[::-1])[::-1] - at, limit).astype(np.int32)  # triplets from here on
    kind, whole = (np.float32, np.int16) if limit <= 128 else (np.float64, np.int64)
    triplet = code[:-2] * 16 + code[1:-1] * 4 + code[2:]
    reach, own, pairs = np.zeros(m, np.int32), np.zeros(m, whole), np.zeros(m, whole)
    best = np.full(m, np.nextafter(kind(threshold / 10), kind(np.inf)), kind)
    room = room.astype(np.int16) if limit < 1 << 15 else room
    for n in range(1, int(room.max(initial=0))):
        k = m - n
        own[:k] += triplet[:k] == triplet[n:]
        pairs = pairs[1 : k + 1] + own[:k]
        score = np.divide(pairs, kind(n), dtype=kind)
        best = np.maximum(best[:-1], best[1:])
        perfect = score >= best
        perfect &= room[:k] > n
        np.copyto(reach[:k], n + 3, where=perfect)
        np.maximum(best, score, out=best)
    return reach


def perfect_intervals(run: str, window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Merged ``(start, end)`` of the perfect intervals of a run of bases."""
    return _intervals(low_complexity(np.frombuffer(run.encode("ascii"), np.uint8), None, window, threshold))


def _intervals(masked: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], masked.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _shown(text: np.ndarray, masked: np.ndarray) -> np.ndarray:
    """Bytes with bases in upper case and masked ones in lower case."""
    return np.where(_codes[text] < _OTHER, text & 0xDF, text) | masked.view(np.uint8) << 5


def dust_mask(seq: str, window: int = WINDOW, threshold: int = THRESHOLD, replace_with: str | None = None) -> str:
    """The sequence with its bases in upper case and masked ones in lower case, or replaced."""
    text = np.frombuffer(seq.encode(), np.uint8)
    masked = low_complexity(text, None, window, threshold)
    shown = _shown(text, masked).tobytes()
    if not replace_with:
        return shown.decode()
    out, at = [], 0
    for s, e in _intervals(masked):
        out += [shown[at:s], replace_with.encode() * (e - s)]
        at = e
    return b"".join([*out, shown[at:]]).decode()


def _mask_column(column: pa.Array, window: int, threshold: int) -> pa.Array:
    """All texts of a column masked at once, where they lie side by side in its buffer."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    if ends[-1] == ends[0]:
        return column
    text = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    shown = _shown(text, low_complexity(text, ends, window, threshold))
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(shown), column.is_valid().buffers()[1])


def mask_low_complexity(sequences: DataFrame, seq_col: str = "seq", window: int = WINDOW, threshold: int = THRESHOLD, replace_with: str | None = None) -> DataFrame:
    """``sequences`` with their texts masked; other columns as they are, null stays null, no shuffle."""
    ship(sequences.sparkSession)
    at = sequences.columns.index(seq_col)

    def masked(column):
        if not replace_with:
            return _mask_column(column, window, threshold)
        return pa.array([None if s is None else dust_mask(s, window, threshold, replace_with) for s in column.to_pylist()], pa.string())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([masked(c) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return sequences.withColumn(seq_col, F.col(seq_col).cast("string")).mapInArrow(run, sequences.withColumn(seq_col, F.col(seq_col).cast("string")).schema)
