"""Counts, shares and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, total: Column) -> Column:
    """Percentage with a zero for an empty total."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def source_counts(examples: DataFrame) -> DataFrame:
    """Kept rows per domain."""
    return examples.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def share_report(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """Weight per key, and its percentage of the whole. The window sees one row per
    key."""
    grouped = df.groupBy(key).agg(F.sum(weight).alias("total"))
    whole = F.sum("total").over(Window.partitionBy())
    return grouped.select(key, "total", percent(F.col("total"), whole).alias("pct"))


def mix_ratio(examples: DataFrame) -> DataFrame:
    """Actual share of each domain, one decimal; no rows for no examples."""
    counts = share_report(examples, "domain", F.lit(1))
    return counts.select(
        "domain", F.col("total").alias("n"), F.round("pct", 1).alias("pct")
    )


def domain_stats(split_examples: DataFrame) -> DataFrame:
    """``(split, domain, n, pct)``: count and share of each domain per split.
    The window sees one row per split and domain."""
    counts = split_examples.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return counts.select("split", "domain", "n", percent(F.col("n"), total).alias("pct"))


def domain_stats_wide(stats: DataFrame, domains: Sequence[str]) -> DataFrame:
    """One row per split with ``<domain>_count`` and ``<domain>_percent``."""
    columns = []
    for d in domains:
        hit = F.col("domain") == d
        columns += [
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{d}_count"),
            F.coalesce(F.sum(F.when(hit, F.col("pct"))), F.lit(0.0)).alias(f"{d}_percent"),
        ]
    return stats.groupBy("split").agg(*columns)


def attribution(
    examples: DataFrame,
    facts: dict[str, str],
    labels: dict[str, str],
    min_words_exclusive: int,
    processing_date: str,
) -> DataFrame:
    """One row: what went into the table, under which terms, in which mix.

    ``facts`` are copied (source names, licence, terms, modifications);
    ``labels`` name the domains in the mix text, in that order.
    """
    sums = [
        F.sum(F.when(F.col("domain") == d, F.lit(1)).otherwise(F.lit(0))).alias(f"_n{i}")
        for i, d in enumerate(labels)
    ]
    counted = examples.agg(F.count(F.lit(1)).alias("processed_examples"), *sums)
    n = F.col("processed_examples")
    texts = [
        F.concat(
            F.format_string("%.1f", F.col(f"_n{i}") / n * 100), F.lit(f"% {label}")
        )
        for i, label in enumerate(labels.values())
    ]
    return counted.select(
        *[F.lit(v).alias(k) for k, v in facts.items()],
        F.when(n > 0, F.concat_ws(", ", *texts)).alias("mix_ratio"),
        "processed_examples",
        F.lit(processing_date).alias("processing_date"),
        F.lit(min_words_exclusive).alias("min_words_exclusive"),
    )
