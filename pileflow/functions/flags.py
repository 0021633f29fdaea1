"""Predicates on the SAM flag field and read classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the SAM flag field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10
READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(bits: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bits)) != 0


def lacks(bits: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bits)) == 0


def is_primary() -> Column:
    """Neither secondary nor supplementary."""
    return lacks(SECONDARY | SUPPLEMENTARY)


def read_class() -> Column:
    """0 QC failure, -3 unmapped, 2 mapped duplicate, 1 any other mapped read."""
    return F.when(has(QCFAIL), 0).when(has(UNMAPPED), -3).when(has(DUPLICATE), 2).otherwise(1)


def placed() -> Column:
    """Has a reference and isn't a passing unmapped read; QC failures stay in."""
    return (F.col("rname") != "*") & (F.col("flag").bitwiseAND(F.lit(QCFAIL | UNMAPPED)) != UNMAPPED)


def not_duplicate() -> Column:
    """Any class but that of mapped duplicates; one look at the flag, which may be a costly expression."""
    return F.col("flag").bitwiseAND(F.lit(QCFAIL | UNMAPPED | DUPLICATE)) != DUPLICATE


def is_clean(mapq: int) -> Column:
    """Counts towards de-duplicated depth."""
    return not_duplicate() & (F.col("mapq") >= mapq)
