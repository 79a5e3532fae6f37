"""Scalar functions on sequences and headers, as Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from phylospan.shipping import ship

#: The codon table, by a codon's bases in the order AGCT (fixed values).
CODON_BASES = "AGCT"
AMINO_ACIDS = "KKNNRRSSTTTTIMIIEEDDGGGGAAAAVVVVQQHHRRRRPPPPLLLL**YY*WCCSSSSLLFF"
#: Letters of standard ranks (fixed values).
RANK_LETTERS = {"superkingdom": "D", "domain": "D", "kingdom": "K", "phylum": "P", "class": "C", "order": "O", "family": "F", "genus": "G", "species": "S"}
#: BLAST's amino acids by number (fixed values).
PROTEIN_CODES = "-ABCDEFGHIKLMNPQRSTVWXYZU*OJ"


def mask_low_quality(seq: Column, quals: Column, minimum: int, fmt: Column | None = None) -> Column:
    """``seq`` with ``x`` for every base whose quality, less 33 modulo 256, is below ``minimum``; FASTQ only."""
    if minimum <= 0:
        return seq
    quality = F.transform(F.split(quals, ""), lambda q: F.pmod(F.ascii(q) - 33, F.lit(256)))
    kept = F.zip_with(F.split(seq, ""), quality, lambda b, q: F.when(q < minimum, F.lit("x")).otherwise(b))
    masked = F.when(F.length(seq) == 0, seq).otherwise(F.array_join(kept, ""))
    fits = F.length(F.coalesce(quals, F.lit(""))) == F.length(seq)
    return F.when(fits if fmt is None else fits & (fmt == "fastq"), masked).otherwise(seq)


def trim_pair_suffix(header: Column) -> Column:
    """A header without a final ``/1`` or ``/2``, if anything stands before it."""
    return F.regexp_replace(header, r"(?s)(?<=.)/[12]$(?!\n)", "")


def sequence_ids(header: Column) -> Column:
    """The first words of a header's parts, which byte 1 separates; a part that begins with white space has none."""
    words = F.transform(F.split(header, "\x01"), lambda p: F.regexp_extract(p, r"^([^\s\x1c-\x1f]*)", 1))
    return F.filter(words, lambda w: w != "")


def first_fields(text: Column, delimiter: str, most: int) -> Column:
    """The first ``most`` fields of a text; what follows them is dropped."""
    quoted = "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in delimiter)
    return F.slice(F.split(text, quoted), 1, most)


def header_taxid(header: Column) -> Column:
    """The number in a ``name:taxid|N|`` or ``taxid|N|`` tag of a header's first word, else null."""
    found = F.regexp_extract(F.regexp_extract(header, r"^>?(\S*)", 1), r"(?:^|\||[a-z]+:)taxid\|(\d+)\|", 1)
    return F.when(found != "", found.cast("long"))


def wrapped(seq: Column, width: int) -> Column:
    """A sequence in lines of ``width``."""
    return F.regexp_replace(seq, f"(?s)(.{{{width}}})(?!$)", "$1\n")


def fasta_text(header: Column, comment: Column, seq: Column, width: int = 72) -> Column:
    """A FASTA record without its last line break."""
    head = F.concat(F.lit(">"), header, F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit(" "), comment)).otherwise(F.lit("")))
    return F.when(F.length(seq) > 0, F.concat_ws("\n", head, wrapped(seq, width))).otherwise(head)


def reverse_complement_text(seq: Column) -> Column:
    return F.translate(F.reverse(F.translate(seq, "acgt", "ACGT")), "ACGT", "TGCA")


def rank_letter(rank: Column) -> Column:
    """The letter of a standard rank, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in RANK_LETTERS.items() for x in pair]), rank)


def percent(part: Column, whole: Column) -> Column:
    """A percentage in six places with two decimals; ``   NaN`` where the whole is nothing."""
    return F.when(whole == 0, F.lit("   NaN")).otherwise(F.format_string("%6.2f", F.lit(100.0) * part / F.when(whole != 0, whole)))


def six_frames(seq: Column) -> Column:
    """The six translations of a DNA sequence, in order.

    A frame has the codons whose last base is at the frame's number modulo 3; frames 3 to 5 are those of
    frames 0 to 2 read backwards on the other strand.  A codon with anything but A, C, G, T is ``X``; a
    sequence of under three bases has six texts of spaces, as long as its longest frame could be.
    """
    return _six_frames(seq)


@lru_cache(1)
def _codon_tables() -> tuple[np.ndarray, np.ndarray]:
    """Amino acids by three bases (numbers in the order AGCT, 4 for others), read on this strand and on the other."""
    ahead = np.full((5, 5, 5), ord("X"), np.uint8)
    ahead[:4, :4, :4] = np.frombuffer(AMINO_ACIDS.encode(), np.uint8).reshape(4, 4, 4)
    other = [3, 2, 1, 0, 4]  # AGCT is its own complement backwards
    return ahead.ravel(), ahead[np.ix_(other, other, other)].transpose(2, 1, 0).ravel()


_base = np.full(256, 4, np.uint8)
for _k, _c in enumerate(CODON_BASES):
    _base[[ord(_c), ord(_c.lower())]] = _k


def translations(seq: str | None) -> list[str]:
    """The six translations of one sequence; see :func:`six_frames`."""
    code = _base[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    n = len(code)
    if n < 3:
        return ["" if seq is None else " "] * 6
    number = code[:-2] * np.uint8(25) + code[1:-1] * np.uint8(5) + code[2:]
    ahead, back = (t[number] for t in _codon_tables())
    firsts = (1, 2, 0)  # a codon that starts at 0 ends at 2
    return [ahead[f::3].tobytes().decode("ascii") for f in firsts] + [back[f::3][::-1].tobytes().decode("ascii") for f in firsts]


def _six_frames(seq: Column) -> Column:
    def frames(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([translations(s) for s in texts])

    if (context := SparkSession.getActiveSession()) is not None:
        ship(context)
    return F.pandas_udf(frames, "array<string>")(seq)
