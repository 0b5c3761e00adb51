"""Integer encodings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    return F.when(n >= 0, n * 2).otherwise(n * -2 - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.expr("0") + (z / 2).cast("long")).otherwise(-((z + 1) / 2).cast("long"))


def bits(n: Column) -> Column:
    """Bits that hold a non-negative number, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(n)))


def uvarint_bytes(n: Column) -> Column:
    """Bytes of the base-128 encoding of a non-negative number."""
    return F.ceil(bits(n) / 7).cast("long")
