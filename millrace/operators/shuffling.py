"""Seeded row orders: a global permutation and the reader's block shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import hash_number, order_hash
from millrace.operators.joining import join_null_safe
from millrace.operators.ranking import MIN_BIN, rank_by_hash, rank_in_bins
from millrace.session import pin


def seeded_shuffle(df: DataFrame, seed: int, key: str = "id", name: str = "shuffle_pos") -> DataFrame:
    """Add each row's position in a permutation fixed by ``seed``."""
    return rank_by_hash(df, order_hash(seed, F.col(key)), [key], totals={name: None})


def shard_order(shards: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Per shard, its rank in this epoch's order and the reading position of
    its first sample. ``shards`` holds one row ``(shard_idx, n)`` per shard."""
    digest = order_hash(seed, epoch, F.col("shard_idx"))
    totals = {"shard_rank": None, "first_pos": F.col("n")}
    return rank_by_hash(shards, digest, ["shard_idx"], totals=totals)


def read_positions(samples: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Add ``pos``: reading position when the shards come in shuffled order and
    the samples of a shard in stored order."""
    shards = pin(samples.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n")), "shards")
    order = pin(shard_order(shards, seed, epoch).select("shard_idx", "first_pos"), "shard-order")
    return (
        join_null_safe(samples, order, ["shard_idx"])
        .withColumn("pos", F.col("first_pos") + F.col("shard_pos"))
        .drop("first_pos")
    )


def block_shuffle(
    df: DataFrame, seed: int, epoch: int, key: str, block: int, pos: str = "pos"
) -> DataFrame:
    """Permute rows within consecutive blocks of ``block`` positions."""
    if block < 1:
        raise ValueError("block must be at least 1")
    number = F.expr(f"`{pos}` div {block}")
    inside = Window.partitionBy("_block").orderBy(order_hash(seed, epoch, F.col(key)), F.col(key))
    return (
        df.withColumn("_block", number)
        .withColumn(pos, F.col("_block") * block + F.row_number().over(inside) - 1)
        .drop("_block")
    )


def buffer_shuffle(df: DataFrame, seed: int, epoch: int, key: str, buffer: int, pos: str = "pos") -> DataFrame:
    """Shuffle as a buffer of ``buffer`` rows does: rows come in the order of their position
    plus a draw below ``buffer``, so each may pass any of its neighbours, and none moves by
    ``buffer`` places or more.

    Positions are dense, so ranges of the sum make even bins, which are ranked apart.
    """
    if buffer < 1:
        raise ValueError("buffer must be at least 1")
    digest = order_hash(seed, epoch, F.col(key))
    moved = df.withColumn("_digest", digest).withColumn("_at", F.col(pos) + hash_number(F.col("_digest")) % buffer)
    bins = F.expr(f"_at div {max(MIN_BIN, buffer)}")
    order = [F.col("_at"), F.col("_digest"), F.col(key)]
    ranked = rank_in_bins(moved.withColumnRenamed(pos, "_before"), bins, order, totals={pos: None})
    return ranked.select(*[F.col(c) for c in df.columns])


def chunk_shuffle(
    df: DataFrame,
    seed: int,
    epoch: int,
    rows: int,
    chunk: int = 500,
    group: int = 1000,
    pos: str = "pos",
) -> DataFrame:
    """Permute whole chunks of ``chunk`` positions inside runs of ``group``
    chunks, keeping the order within a chunk; a short last chunk is kept.

    ``rows`` is the number of rows; with dense positions it fixes the chunks,
    so their order is worked out without looking at the rows.
    """
    chunks = df.sparkSession.range(-(-rows // chunk)).select(
        F.col("id").alias("_moved"),
        F.least(F.lit(chunk), F.lit(rows) - F.col("id") * chunk).alias("_n"),
        F.expr(f"id div {group}").alias("_group"),
    )
    in_group = (
        Window.partitionBy("_group")
        .orderBy(order_hash(seed, epoch, F.col("_moved")), "_moved")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_group") * (chunk * group) + F.coalesce(F.sum("_n").over(in_group), F.lit(0))
    placed = chunks.select("_moved", first.alias("_first"))
    numbered = df.withColumn("_chunk", F.expr(f"`{pos}` div {chunk}"))
    return (
        numbered.join(placed, F.col("_chunk") == F.col("_moved"))
        .withColumn(pos, (F.col("_first") + F.col(pos) % chunk).cast("bigint"))
        .drop("_chunk", "_moved", "_first")
    )
