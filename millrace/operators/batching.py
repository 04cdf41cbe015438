"""Fixed-size batches over a dense reading position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_batches(
    df: DataFrame, batch_size: int, drop_last: bool, pos: str = "pos", rows: int | None = None
) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos``; with ``drop_last`` rows of an
    incomplete last batch go. No exchange: the batch follows from ``pos``.
    The number of rows, if known, spares the pass that would count them."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    numbered = df.withColumn("batch_id", F.expr(f"`{pos}` div {batch_size}")).withColumn(
        "batch_pos", (F.col(pos) % batch_size).cast("int")
    )
    if not drop_last:
        return numbered
    if rows is not None:
        return numbered.filter(F.col("batch_id") < rows // batch_size)
    full = df.agg((F.max(pos) + 1).alias("n")).select(F.expr(f"n div {batch_size}")).scalar()
    return numbered.filter(F.col("batch_id") < full)


def limit_batches(batches: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` batches."""
    return batches.filter(F.col("batch_id") < n)


def collate(batches: DataFrame, *columns: str) -> DataFrame:
    """One row per batch, each column an array in batch order. A group holds
    one batch, so its size is fixed."""
    packed = F.sort_array(F.collect_list(F.struct("batch_pos", *columns)))
    rows = batches.groupBy("batch_id").agg(packed.alias("_rows"))
    return rows.select(
        "batch_id",
        F.size("_rows").alias("n"),
        *[F.col("_rows").getField(c).alias(c) for c in columns],
    )
