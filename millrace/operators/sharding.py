"""Shard numbers for fragments, in exact running order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import order_hash
from millrace.functions.tokens import fragment_count, sample_key
from millrace.operators.ranking import rank_by_hash, running_total
from millrace.operators.tokenizing import fragments


def sharded_fragments(
    documents: DataFrame,
    length: int,
    stride: int,
    pad_id: int,
    shard_size: int,
    pos: str = "split_pos",
    by: tuple[str, ...] = ("split",),
) -> DataFrame:
    """Fragments with ``shard_idx``, ``shard_pos`` and ``sample_key``, filled
    in the order of (document position, fragment number) within ``by``.

    ``documents`` has ``id, domain, ids, n_tokens``, a dense ``pos`` and the
    ``by`` columns; pass a written table, as it is read twice, the first time
    without its arrays. A document's first slot is the running total of
    fragments before it, so documents are ordered, never the many fragments.
    """
    counted = documents.select(
        "id", "domain", "ids", pos, *by, fragment_count(F.col("n_tokens"), length, stride).alias("_k")
    )
    placed = running_total(counted, pos, F.col("_k"), by, name="_first")
    return _cut_and_numbered(placed, length, stride, pad_id, shard_size, by)


def shuffled_fragments(
    documents: DataFrame,
    seed: int,
    length: int,
    stride: int,
    pad_id: int,
    shard_size: int,
    by: tuple[str, ...] = ("split",),
) -> DataFrame:
    """``sharded_fragments`` in the seeded order of ``split_positions``, for documents
    without a position.

    Position and first slot are totals over the same order, so one exchange gives
    both; it carries the token arrays, and the texts never move.
    """
    counted = documents.select(
        "id", "domain", "ids", *by, fragment_count(F.col("n_tokens"), length, stride).alias("_k")
    )
    digest = order_hash(seed, "order", F.col("id"))
    placed = rank_by_hash(counted, digest, ["id"], by, {"_first": F.col("_k")})
    return _cut_and_numbered(placed, length, stride, pad_id, shard_size, by)


def shuffled_slots(
    documents: DataFrame,
    seed: int,
    length: int,
    stride: int,
    shard_size: int,
    by: tuple[str, ...] = ("split",),
) -> DataFrame:
    """``shuffled_fragments`` without their arrays, from ``id, domain, n_tokens`` and the ``by``
    columns alone: which fragments there are, and where, follows from the numbers of tokens."""
    counted = documents.select("id", "domain", *by, fragment_count(F.col("n_tokens"), length, stride).alias("_k"))
    digest = order_hash(seed, "order", F.col("id"))
    placed = rank_by_hash(counted, digest, ["id"], by, {"_first": F.col("_k")})
    numbers = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("fragment_idx")
    slots = placed.select(F.col("id").alias("original_id"), "domain", *by, "_first", numbers)
    return _numbered(slots, shard_size)


def _cut_and_numbered(
    placed: DataFrame, length: int, stride: int, pad_id: int, shard_size: int, by: tuple[str, ...]
) -> DataFrame:
    return _numbered(fragments(placed, length, stride, pad_id, keep=(*by, "_first")), shard_size)


def _numbered(cut: DataFrame, shard_size: int) -> DataFrame:
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    slot = F.col("_first") + F.col("fragment_idx")
    return (
        cut.withColumn("_slot", slot)
        .withColumn("shard_idx", F.expr(f"cast(_slot div {shard_size} as int)"))
        .withColumn("shard_pos", (F.col("_slot") % shard_size).cast("int"))
        .withColumn("sample_key", sample_key(F.col("shard_idx"), F.col("shard_pos")))
        .drop("_slot", "_first")
    )


def shard_summary(sharded: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Fragments and shards per split."""
    return sharded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fragments"),
        (F.max("shard_idx") + 1).cast("bigint").alias("n_shards"),
    )
