"""Minimizers of sequences: the Arrow scan that the engine uses, and its twin in plain columns.

With ``e`` bases read, the token's minimizer is the least canonical l-mer (masked and toggled) among those
that start at ``e - k .. e - l``.  A token is ambiguous if fewer than ``k - 1`` bases (``k`` where ``k = l``)
follow the last ambiguous base.  Equal neighbours are kept as runs, which is all that classification needs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.functions.bits import fmix64, reverse_complement, signed
from phylospan.model import IndexOptions
from phylospan.shipping import ship

#: The reduced protein alphabet, by code (fixed values).
PROTEIN_GROUPS = ("*UO", "A", "NQS", "C", "DE", "F", "G", "H", "IL", "K", "P", "R", "MV", "T", "W", "Y")
_NONE = np.uint64((1 << 64) - 1)


@lru_cache(4)
def alphabet(dna: bool) -> np.ndarray:
    """Codes by byte; 255 is ambiguous."""
    codes = np.full(256, 255, np.uint8)
    for code, letters in enumerate("ACGT" if dna else PROTEIN_GROUPS):
        for c in letters:
            codes[ord(c)] = codes[ord(c.lower())] = code
    return codes


def candidates(codes: np.ndarray, o: IndexOptions) -> np.ndarray:
    """The toggled l-mer at every position; the largest number where one has an ambiguous base."""
    n = len(codes) - o.l + 1
    bad = np.concatenate(([0], np.cumsum(codes == 255)))
    base = np.where(codes == 255, 0, codes).astype(np.uint64)
    value, back, size = None, None, 0
    power, turned, width = base, np.uint64(3) - base, 1  # stretches of a power of two, and their complements reversed
    while True:
        if o.l & width:
            part, other = power[size : size + n], turned[size : size + n]
            shift = np.uint64(o.bits * width)
            value = part if value is None else (value << shift) | part
            back = other if back is None else back | (other << np.uint64(2 * size))
            size += width
        if size == o.l:
            break
        shift = np.uint64(o.bits * width)
        power = (power[:-width] << shift) | power[width:]
        turned = turned[:-width] | (turned[width:] << np.uint64(2 * width)) if o.dna else turned[:-width]
        width *= 2
    if o.dna:
        if o.revcom_version == 0:
            back = np.fromiter((reverse_complement(int(v), o.l, 0) for v in value), np.uint64, n)
        value = np.minimum(value, back)
    else:
        value = value.copy()
    if o.spaced_seed_mask:
        value &= np.uint64(o.spaced_seed_mask & ((1 << 64) - 1))
    value ^= np.uint64(o.toggle)
    value[bad[o.l :] != bad[: n]] = _NONE
    return value


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, in a logarithmic number of steps."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def tokens(seq: bytes, o: IndexOptions) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers (unsigned) and ambiguity of a sequence's tokens, one per base from the ``k``-th on."""
    n = len(seq)
    if n < o.k:
        return np.empty(0, np.uint64), np.empty(0, bool)
    codes = alphabet(o.dna)[np.frombuffer(seq, np.uint8)]
    least = window_least(candidates(codes, o), o.k - o.l + 1) ^ np.uint64(o.toggle)
    at = np.where(codes == 255, np.arange(n), -1)
    last = np.maximum.accumulate(at)[o.k - 1 :]
    run = np.arange(o.k - 1, n) - last
    return least, (last >= 0) & (run < (o.k - 1 if o.k > o.l else o.k))


#: Bases that are scanned at once; longer sequences are scanned in overlapping pieces.
CHUNK = 1 << 16


def _pieces(seqs: list[bytes], k: int):
    """Groups of ``(sequence number, bytes)`` of about :data:`CHUNK` bases; a long sequence's pieces overlap by ``k - 1``."""
    held, size = [], 0
    for number, seq in enumerate(seqs):
        for lo in range(0, max(1, len(seq) - k + 1), CHUNK):
            part = seq[lo : lo + CHUNK + k - 1]
            if len(part) < k:
                continue
            held.append((number, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs_of(seqs: list[bytes], o: IndexOptions):
    """Runs of equal tokens of many sequences: ``(sequence, minimizer, ambiguous, fresh, tokens)`` arrays.

    Sequences are scanned together with an ambiguous base between them; a long one's runs are cut where its
    pieces meet.  ``fresh`` marks a run whose
    minimizer differs from the sequence's last unambiguous one, which opens a hit group.  Minimizers of
    ambiguous runs are 0.
    """
    owners, values, flags, sizes = [], [], [], []
    for group in _pieces(seqs, o.k):
        m, ambiguous = tokens(b"\0".join(part for _, part in group), o)
        size = np.array([len(part) for _, part in group])
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        count = size - o.k + 1
        at = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        owner = np.repeat(np.array([n for n, _ in group]), count)
        m, ambiguous = m[at], ambiguous[at]
        m[ambiguous] = 0
        new = np.empty(len(m), bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        new[1:] |= ambiguous[1:] != ambiguous[:-1]
        new[np.concatenate(([0], np.cumsum(count)[:-1]))] = True
        first = np.flatnonzero(new)
        owners.append(owner[first])
        values.append(m[first])
        flags.append(ambiguous[first])
        sizes.append(np.diff(first, append=len(m)).astype(np.int32))
    if not owners:
        none = np.empty(0, bool)
        return np.empty(0, np.int64), np.empty(0, np.uint64), none, none, np.empty(0, np.int32)
    owner, m, ambiguous, size = map(np.concatenate, (owners, values, flags, sizes))
    fresh = ~ambiguous
    clear = np.flatnonzero(fresh)
    fresh[clear[1:]] = (m[clear[1:]] != m[clear[:-1]]) | (owner[clear[1:]] != owner[clear[:-1]])
    return owner, m, ambiguous, fresh, size


def runs(seq: bytes, o: IndexOptions):
    """``(minimizer, ambiguous, fresh, tokens)`` arrays of one sequence."""
    return runs_of([seq], o)[1:]


class _Scan:
    """Batches of ``(read, mate, frame, seq)`` to rows of runs."""

    schema = pa.schema([("read", pa.int64()), ("mate", pa.int32()), ("frame", pa.int32()), ("run", pa.int32()), ("minimizer", pa.int64()), ("ambiguous", pa.bool_()), ("fresh", pa.bool_()), ("low", pa.bool_()), ("tokens", pa.int32())])
    ddl = "read long, mate int, frame int, run int, minimizer long, ambiguous boolean, fresh boolean, low boolean, tokens int"

    def __init__(self, options: IndexOptions):
        self.options = options

    def __call__(self, batches):
        o = self.options
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                read, mate, frame = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                owner, m, ambiguous, fresh, n = runs_of([(s or "").encode("latin-1", "replace") for s in part.column(3).to_pylist()], o)
                if not len(m):
                    continue
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                number = np.arange(len(m)) - np.repeat(first, np.diff(np.r_[first, len(m)]))
                low = fmix64(m) < np.uint64(o.min_hash) if o.min_hash else np.zeros(len(m), bool)
                cols = (read[owner], mate[owner], frame[owner], number, m.view(np.int64), ambiguous, fresh, low, n)
                for at in range(0, len(m), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)], t) for c, t in zip(cols, self.schema.types)], schema=self.schema)


def minimizer_runs(frames: DataFrame, o: IndexOptions) -> DataFrame:
    """Runs of ``frames(read, mate, frame, seq)``: ``(read, mate, frame, run, minimizer, ambiguous, fresh, low, tokens)``.

    ``low`` marks minimizers whose hash is below the index's threshold.  Narrow: no shuffle.
    """
    ship(frames.sparkSession)
    return frames.select("read", "mate", "frame", "seq").mapInArrow(_Scan(o), _Scan.ddl)


def single_frames(sequences: DataFrame, id_col: str = "seq_no", seq_col: str = "seq") -> DataFrame:
    """Sequences as frames of one mate and one frame."""
    return sequences.select(F.col(id_col).alias("read"), F.lit(0).alias("mate"), F.lit(0).alias("frame"), F.col(seq_col).alias("seq"))


def found_minimizers(sequences: DataFrame, o: IndexOptions, id_col: str = "seq_no", seq_col: str = "seq") -> DataFrame:
    """Unambiguous minimizers of each sequence that pass the hash threshold, once a run and so repeated: ``(read, minimizer)``."""
    found = minimizer_runs(single_frames(sequences, id_col, seq_col), o)
    return found.where("not ambiguous and not low").select("read", "minimizer")


def minimizers(sequences: DataFrame, o: IndexOptions, id_col: str = "seq_no", seq_col: str = "seq") -> DataFrame:
    """Distinct unambiguous minimizers of each sequence that pass the hash threshold: ``(read, minimizer)``."""
    return found_minimizers(sequences, o, id_col, seq_col).distinct()


def minimizer_tokens(sequences: DataFrame, o: IndexOptions, id_col: str = "seq_no", seq_col: str = "seq") -> DataFrame:
    """Every token in plain columns, without Python: ``(read, pos, minimizer, ambiguous)``, ``minimizer`` null if ambiguous.

    The engine's scan gives the same; this form is its cross-check and serves plans that must stay in the JVM.
    """
    letters = "ACGT" if o.dna else "".join("0123456789ABCDEF"[k] * len(g) for k, g in enumerate(PROTEIN_GROUPS))
    seq = F.translate(F.col(seq_col), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if o.dna:
        digits, base, good = F.translate(seq, letters, "0123"), 4, "^[ACGT]*$"
        other = F.translate(F.reverse(seq), "ACGT", "3210")
    else:
        digits, base, good = F.translate(seq, "".join(PROTEIN_GROUPS), letters), 16, "^[%s]*$" % "".join(PROTEIN_GROUPS).replace("*", r"\*")
        other = None
    n = F.length(seq)
    positions = F.when(n >= o.l, F.sequence(F.lit(0), F.greatest(n - o.l, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def candidate(i):
        forward = F.conv(F.substring(digits, i + 1, F.lit(o.l)), base, 10).cast("long")
        if other is not None:
            forward = F.least(forward, F.conv(F.substring(other, n - o.l - i + 1, F.lit(o.l)), base, 10).cast("long"))
        if o.spaced_seed_mask:
            forward = forward.bitwiseAND(F.lit(signed(o.spaced_seed_mask)))
        return F.when(F.substring(seq, i + 1, F.lit(o.l)).rlike(good), forward.bitwiseXOR(F.lit(o.toggle)))

    rows = sequences.select(F.col(id_col).alias("read"), seq.alias("s"), F.transform(positions, candidate).alias("c"))
    width, need = o.k - o.l + 1, o.k - 1 if o.k > o.l else o.k
    ends = rows.where(F.length("s") >= o.k).select("read", "s", "c", F.explode(F.sequence(F.lit(o.k), F.length("s"))).alias("e"))
    clear = F.substring(F.col("s"), F.greatest(F.col("e") - need + 1, F.lit(1)), F.least(F.lit(need), F.col("e"))).rlike(good)
    least = F.array_min(F.slice(F.col("c"), F.col("e") - o.k + 1, F.lit(width)))
    return ends.select("read", (F.col("e") - o.k).alias("pos"), F.when(clear, least.bitwiseXOR(F.lit(o.toggle))).alias("minimizer"), (~clear).alias("ambiguous"))
