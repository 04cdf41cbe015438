"""Next-token filtering and sampling over tables of logits.

Array form: one row holds all logits of a step; nothing is shuffled. Long form:
one row per token ``(row_id, tok, z)``, for logits stored that way. There a step's tokens
are counted by bins of their distance from its largest logit, before any exchange; the bins
tell where the limit falls, and only the tokens of that bin are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.binding import let
from millrace.functions.hashing import uniform
from millrace.functions.logits import (
    draw_token,
    ranked_tokens,
    scaled,
    survivor_probabilities,
    top_k_survivors,
    top_p_survivors,
)
from millrace.operators.joining import join_lookup
from millrace.session import pin


def _survivors(logits: str, top_k: int, top_p: float, temperature: float):
    ranked = ranked_tokens(scaled(F.col(logits), temperature))
    return top_p_survivors(top_k_survivors(ranked, top_k), top_p)


def surviving_tokens(
    df: DataFrame,
    row_id: str,
    top_k: int = 50,
    top_p: float = 0.9,
    temperature: float = 1.0,
    logits: str = "logits",
) -> DataFrame:
    """``(row_id, tok, z, p)`` of the tokens left after temperature, top-k and
    top-p, with their renormalised probabilities."""
    paired = let(
        _survivors(logits, top_k, top_p, temperature),
        lambda r: F.zip_with(
            r,
            survivor_probabilities(r),
            lambda s, p: F.struct(s["tok"].alias("tok"), (-s["neg"]).alias("z"), p.alias("p")),
        ),
    )
    return df.select(row_id, F.explode(paired).alias("_s")).select(row_id, "_s.*")


def sample_next_token(
    df: DataFrame,
    row_id: str,
    seed: int,
    step: int = 0,
    top_k: int = 50,
    top_p: float = 0.9,
    temperature: float = 1.0,
    logits: str = "logits",
    name: str = "token",
) -> DataFrame:
    """Add one drawn token per row; the draw depends on seed, row and step."""
    u = uniform(seed, F.col(row_id), step)
    return df.withColumn(
        name, let(u, lambda v: draw_token(_survivors(logits, top_k, top_p, temperature), v))
    )


BINS_PER_UNIT = 64
LAST_BIN = 1 << 14  # holds all logits further below the largest


def _binned(tokens: DataFrame, row_id: str) -> DataFrame:
    """``tokens`` with ``_bin``, and ``_e``, the exponential of the distance from the largest logit."""
    top = pin(tokens.groupBy(row_id).agg(F.max("z").alias("_top")), "largest")
    below = F.col("_top") - F.col("z")
    number = F.least(F.floor(below * BINS_PER_UNIT), F.lit(LAST_BIN))
    return join_lookup(tokens, top, row_id, "tok").withColumn("_bin", number).withColumn("_e", F.exp(-below)).drop("_top")


def _with_border(binned: DataFrame, row_id: str, weight: Column, reached: Column) -> DataFrame:
    """``binned`` with the bin in which its step's limit falls (``_border``, null: in none) and the
    weight before that bin. ``reached``, of ``_before``, ``_upto`` and ``_all``, is true from the
    border on."""
    row = Window.partitionBy(row_id)
    upto = row.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        binned.groupBy(row_id, "_bin")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_upto", F.sum("_w").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("_w"))
        .withColumn("_all", F.sum("_w").over(row))
    )
    at = F.struct(F.col("_bin").alias("_border"), "_before", "_all")
    borders = bins.groupBy(row_id).agg(F.min(F.when(reached, at)).alias("_at"))
    return join_lookup(binned, pin(borders, "borders"), row_id, "tok")


def _kept(placed: DataFrame, tokens: DataFrame, inside: DataFrame) -> DataFrame:
    """Tokens before the border of their step, and those of its border bin that are ``inside``."""
    columns = [F.col(c) for c in tokens.columns]
    before = placed.where(F.col("_at").isNull() | (F.col("_bin") < F.col("_at._border")))
    return before.select(*columns).union(inside.select(*columns))


def long_top_k(tokens: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    """Tokens whose logit reaches the k-th largest of their row; ties stay."""
    if k <= 0:
        return tokens
    placed = _with_border(_binned(tokens, row_id), row_id, F.lit(1), F.col("_upto") >= k)
    border = placed.where(F.col("_bin") == F.col("_at._border"))
    rank = F.rank().over(Window.partitionBy(row_id).orderBy(F.col("z").desc()))
    inside = border.withColumn("_rank", rank + F.col("_at._before")).where(F.col("_rank") <= k)
    return _kept(placed, tokens, inside)


def long_top_p(tokens: DataFrame, p: float, row_id: str = "row_id") -> DataFrame:
    """Tokens before which their row's probability mass is at most ``p``; of equal logits the
    lesser token comes first."""
    if p <= 0:
        return tokens
    placed = _with_border(_binned(tokens, row_id), row_id, F.col("_e"), F.col("_upto") > F.lit(p) * F.col("_all"))
    border = placed.where(F.col("_bin") == F.col("_at._border"))
    earlier = Window.partitionBy(row_id).orderBy(F.col("z").desc(), F.col("tok")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("_at._before") + F.coalesce(F.sum("_e").over(earlier), F.lit(0.0))
    inside = border.withColumn("_mass", mass).where(F.col("_mass") <= F.lit(p) * F.col("_at._all"))
    return _kept(placed, tokens, inside)
