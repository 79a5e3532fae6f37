"""Options, constants and table schemas of the classifier."""

from __future__ import annotations

from dataclasses import asdict, dataclass

#: The default toggle mask, and the version of the reverse complement that new indexes use.
TOGGLE = 0xE37E28C4271B5A2D
REVCOM_VERSION = 1

SEQUENCES = "seq_no long, mate int, header string, comment string, seq string, quals string, format string"
TAXONOMY = "node long, parent long, ext_id long, name string, rank string, depth int, path array<long>, entry int, last int"
INDEX = "minimizer long, taxon long"


@dataclass(frozen=True)
class IndexOptions:
    """How sequences become minimizers; ``min_hash`` is an unsigned threshold below which they are left out."""

    k: int = 35
    l: int = 31
    spaced_seed_mask: int = 0
    toggle_mask: int = TOGGLE
    dna: bool = True
    min_hash: int = 0
    revcom_version: int = REVCOM_VERSION

    def __post_init__(self):
        if not 0 < self.l <= self.k:
            raise ValueError("l must be positive and at most k")
        if self.l > (31 if self.dna else 15):
            raise ValueError("l is at most 31 for DNA and 15 for protein")

    @property
    def bits(self) -> int:
        return 2 if self.dna else 4

    @property
    def lmer_mask(self) -> int:
        return (1 << (self.l * self.bits)) - 1

    @property
    def toggle(self) -> int:
        return self.toggle_mask & self.lmer_mask

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ClassifyOptions:
    """Thresholds and modes of classification; ``minimum_hit_groups`` is 0 here and 2 on the command line."""

    confidence: float = 0.0
    minimum_hit_groups: int = 0
    quick: bool = False
    paired: bool = False
    translated: bool = False
    minimum_base_quality: int = 0
    use_names: bool = False

    def __post_init__(self):
        if not 0 <= self.confidence <= 1:
            raise ValueError("confidence lies in [0, 1]")
        if self.minimum_hit_groups < 0 or self.minimum_base_quality < 0:
            raise ValueError("thresholds are not negative")
