"""Start and stop codons of the public translation tables."""

from __future__ import annotations

#: Table number: start codons, stop codons (fixed values).
TABLES = {
    1: ("TTG CTG ATG", "TAA TAG TGA"),
    2: ("ATT ATC ATA ATG GTG", "TAA TAG AGA AGG"),
    3: ("ATA ATG GTG", "TAA TAG"),
    4: ("TTA TTG CTG ATT ATC ATA ATG GTG", "TAA TAG"),
    5: ("TTG ATT ATC ATA ATG GTG", "TAA TAG"),
    6: ("ATG", "TGA"),
    9: ("ATG GTG", "TAA TAG"),
    10: ("ATG", "TAA TAG"),
    11: ("TTG CTG ATT ATC ATA ATG GTG", "TAA TAG TGA"),
    12: ("CTG ATG", "TAA TAG TGA"),
    13: ("TTG ATA ATG GTG", "TAA TAG"),
    14: ("ATG", "TAG"),
    16: ("ATG", "TAA TGA"),
    21: ("ATG GTG", "TAA TAG"),
    22: ("ATG", "TCA TAA TGA"),
    23: ("ATT ATG GTG", "TTA TAA TAG TGA"),
    24: ("TTG CTG ATG GTG", "TAA TAG"),
    25: ("TTG ATG GTG", "TAA TAG"),
    26: ("CTG ATG", "TAA TAG TGA"),
    29: ("ATG", "TGA"),
    30: ("ATG", "TGA"),
    32: ("TTG CTG ATT ATC ATA ATG GTG", "TAA TGA"),
    33: ("TTG CTG ATG GTG", "TAG"),
}


def codons(table: int = 1) -> list[tuple[str, bool, bool]]:
    """(codon, starts, stops) of the codons that do either."""
    starts, stops = (set(x.split()) for x in TABLES[table])
    return [(c, c in starts, c in stops) for c in sorted(starts | stops)]
