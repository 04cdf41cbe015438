"""Joins that keep null keys and survive skewed ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join on same-named columns in which nulls match."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    )
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])


def join_lookup(
    left: DataFrame, lookup: DataFrame, on: str, spread_by: str, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join to a written table with one row per value of ``on``, nulls
    matching, where one value may own most of ``left``.

    A lookup of up to ``rows`` rows is broadcast. A larger one is repeated
    under ``SALTS`` salts, and a value's rows spread over them by the hash of
    ``spread_by``. The repeated rows must not be broadcast: the optimizer takes
    them to be as small as the written table.
    """
    named = lookup.withColumnRenamed(on, "_on")
    match = F.col(on).eqNullSafe(F.col("_on"))
    if lookup.count() <= rows:
        return left.join(F.broadcast(named), match, "left").drop("_on")
    salted = named.withColumn("_other_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash(spread_by), F.lit(SALTS))
    return (
        left.withColumn("_salt", salt)
        .join(salted.hint("merge"), match & (F.col("_salt") == F.col("_other_salt")), "left")
        .drop("_on", "_salt", "_other_salt")
    )
