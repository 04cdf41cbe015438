"""Seeded, engine-independent hash keys for reproducible orders and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 16**8


def order_hash(*parts) -> Column:
    """Hex digest of the parts joined by colons; strings and numbers are
    literals, columns are columns. Sorting by it is a seeded permutation."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_number(digest: Column) -> Column:
    """First 32 bits of a hex digest as a bigint."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Reproducible draw from [0, 1) that depends on the parts only."""
    return hash_number(order_hash(*parts)) / F.lit(float(HASH_RANGE))
