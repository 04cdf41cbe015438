"""Exact stratified train/validation split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import order_hash
from millrace.operators.joining import join_lookup, join_null_safe
from millrace.operators.ranking import HEX_DIGITS, rank_by_hash
from millrace.session import pin

TRAIN, VALIDATION = "train", "validation"


def validation_quotas(counts: DataFrame, ratio: float, domain: str = "domain") -> DataFrame:
    """Rows per domain for validation, from ``(domain, n)``.

    ceil(ratio * all) rows go to the domains in proportion; what the rounding
    down leaves goes to the largest remainders, ties by name. All arithmetic
    on counts is exact. One row per domain, so the small windows are fine.
    """
    everything = Window.partitionBy()
    big = "decimal(38,0)"
    shares = (
        counts.withColumn("_all", F.sum("n").over(everything))
        .withColumn("_want", F.ceil(F.lit(float(ratio)) * F.col("_all")).cast("bigint"))
        .withColumn("_product", F.col("_want").cast(big) * F.col("n").cast("decimal(19,0)"))
        .withColumn("_floor", F.expr("_product div _all"))
        .withColumn("_rest", F.expr("_product % _all"))
    )
    place = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(domain)))
    spare = F.col("_want") - F.sum("_floor").over(everything)
    extra = F.when(place <= spare, F.lit(1)).otherwise(F.lit(0))
    return shares.select(domain, "n", (F.col("_floor") + extra).cast("bigint").alias("n_val"))


def stratified_split(
    df: DataFrame,
    ratio: float,
    seed: int,
    domain: str = "domain",
    key: str = "id",
    check: bool = True,
) -> DataFrame:
    """Add ``split``: in every domain the ``n_val`` rows of smallest hash are
    validation.

    The rows themselves are not shuffled. Counts per hash bin tell in which bin
    a domain's quota ends; only the rows of that bin are ranked, giving one cut
    key per domain, against which each row is compared in place.
    """
    hashed = df.withColumn("_digest", order_hash(seed, "split", F.col(key)))
    bins = pin(
        hashed.groupBy(domain, F.substring("_digest", 1, HEX_DIGITS).alias("_bin")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "split-bins",
    )
    quotas = validation_quotas(bins.groupBy(domain).agg(F.sum("n").alias("n")), ratio, domain)
    upto = Window.partitionBy(domain).orderBy("_bin")
    reached = bins.withColumn("_upto", F.sum("n").over(upto)).withColumnRenamed("n", "_in_bin")
    need = F.col("n_val") - (F.col("_upto") - F.col("_in_bin"))
    # Per domain the bin in which its quota is reached; the first bin stands in
    # where there is none, so that every domain has a row to be checked.
    edge = pin(
        join_null_safe(reached, quotas, [domain])
        .withColumn("_need", need)
        .filter(need.between(1, F.col("_in_bin")) | ((F.col("n_val") < 1) & (F.col("_upto") == F.col("_in_bin"))))
        .select(domain, "n", "n_val", "_bin", "_need"),
        "split-edge",
    )
    if check:
        bad = edge.filter((F.col("n") < 2) | (F.col("n_val") < 1)).limit(5).collect()
        if bad:
            raise ValueError(f"too few rows to stratify: {[r[domain] for r in bad]}")
    edge_rows = join_null_safe(
        hashed.select(domain, key, "_digest", F.substring("_digest", 1, HEX_DIGITS).alias("_bin")),
        edge.select(domain, "_bin", "_need"),
        [domain, "_bin"],
    )
    rank = F.row_number().over(Window.partitionBy(domain).orderBy("_digest", key))
    cuts = pin(
        edge_rows.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(domain, F.struct("_digest", F.col(key).alias("_key")).alias("_cut")),
        "split-cuts",
    )
    own = F.struct("_digest", F.col(key).alias("_key"))
    is_val = F.coalesce(own <= F.col("_cut"), F.lit(False))
    return (
        join_lookup(hashed, cuts, domain, key)
        .withColumn("split", F.when(is_val, F.lit(VALIDATION)).otherwise(F.lit(TRAIN)))
        .drop("_digest", "_cut")
    )


def split_positions(df: DataFrame, seed: int, key: str = "id", name: str = "split_pos") -> DataFrame:
    """Add each row's position in its split, a second seeded permutation."""
    digest = order_hash(seed, "order", F.col(key))
    return rank_by_hash(df, digest, [key], ["split"], {name: None})
