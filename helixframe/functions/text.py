"""String expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decode(value: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus and malformed escapes stay as they are."""
    whole = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.instr(value, "%") > 0, F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), value)).otherwise(value)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTURYKMBDHVacgturykmbdhv", "TGCAAYRMKVHDBtgcaayrmkvhdb"))


def codons(bases: Column) -> Column:
    """The full codons of a sequence, in order."""
    n = F.length(bases)
    whole = F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1)
    return F.when(n >= 3, F.transform(whole, lambda k: F.substring(bases, k * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))
