"""Parameters and row layouts.

``loci`` rows: chr, pos, ref, alleles (labels), counts (one array of allele counts per pool).
``long`` rows: chr, pos, allele, allele_ord, pool_idx, count, coverage, freq; a null freq is
missing. Pools are few; whatever is pools by pools may reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Order of the counts of a pool in a sync file.
ALLELES = ("A", "T", "C", "G", "D", "N")
#: The order some files were read with, where D and N change places.
ALLELES_N_BEFORE_D = ("A", "T", "C", "G", "N", "D")

LOCI_SCHEMA = "chr string, pos long, ref string, alleles array<string>, counts array<array<long>>"
EPSILON = 2.220446049250313e-16


def _rate(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} is {value}; it must lie between 0 and 1")


@dataclass(frozen=True)
class FilterParams:
    """Thresholds of the locus and allele filters."""

    remove_ns: bool = True
    max_base_error_rate: float = 0.01
    min_coverage_depth: int = 1
    min_coverage_breadth: float = 1.0
    min_allele_frequency: float = 0.001
    max_missingness_rate: float = 0.0
    keep_lowercase_reference: bool = False

    def __post_init__(self) -> None:
        for name in ("max_base_error_rate", "min_coverage_breadth", "min_allele_frequency", "max_missingness_rate"):
            _rate(name, getattr(self, name))
        if self.min_coverage_depth < 0:
            raise ValueError("min_coverage_depth must not be negative")


@dataclass(frozen=True)
class WindowParams:
    """Sliding windows along a chromosome, in base pairs."""

    size: int = 100
    slide: int = 50
    min_loci: int = 10
    block: int = 1_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.slide <= self.size:
            raise ValueError("slide must lie between 1 and size")
        if self.block < 2 * self.size:
            raise ValueError("block must be at least twice the size")
