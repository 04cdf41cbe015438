"""Token metrics from logits or predictions.

Logits table: ``batch_id, example_id, domain, pos, logits, target``.
Predictions:  ``batch_id, example_id, domain, pos, predicted, target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.logits import argmax_token, is_hit, smoothed_loss
from millrace.functions.tokens import shift_targets

UNKNOWN_DOMAIN = "unknown"
IGNORE_INDEX = -100


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def next_token_pairs(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per position: the token read and the token to predict."""
    pairs = df.select(
        *keep, F.col(ids).alias("_ids"), F.posexplode(shift_targets(F.col(ids))).alias("pos", "target")
    )
    return pairs.select(
        *keep, "pos", F.element_at("_ids", F.col("pos") + 1).alias("input"), "target"
    )


def predictions(logits: DataFrame) -> DataFrame:
    """Replace the logits by the position of their first maximum."""
    others = [c for c in logits.columns if c != "logits"]
    return logits.select(*others, argmax_token(F.col("logits")).alias("predicted"))


def mean_loss(
    logits: DataFrame, smoothing: float = 0.1, ignore_pad: int | None = None
) -> DataFrame:
    """``(loss, n)``: mean smoothed cross entropy where the target counts.
    Pad targets count too unless ``ignore_pad`` names their id."""
    counted = logits.filter(F.col("target") != IGNORE_INDEX)
    if ignore_pad is not None:
        counted = counted.filter(F.col("target") != ignore_pad)
    return counted.agg(
        F.avg(smoothed_loss(F.col("logits"), F.col("target"), smoothing)).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )


def hit_counts(pad_id: int) -> list[Column]:
    """Sums of hits and of positions that count."""
    hit = is_hit(F.col("predicted"), F.col("target"), pad_id).cast("bigint")
    real = (F.col("target") != pad_id).cast("bigint")
    return [
        F.coalesce(F.sum(hit), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(real), F.lit(0)).alias("total"),
    ]


def batch_accuracy(pred: DataFrame, pad_id: int) -> DataFrame:
    """Token accuracy per batch, null where a batch has pad targets only, and
    the number of examples in it."""
    return accuracy_of_batches(pred.groupBy("batch_id", "example_id").agg(*hit_counts(pad_id)))


def accuracy_of_batches(examples: DataFrame) -> DataFrame:
    """``batch_accuracy`` from the counts of each example."""
    batches = examples.groupBy("batch_id").agg(
        F.sum("correct").alias("correct"),
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return batches.withColumn("accuracy", _ratio(F.col("correct"), F.col("total")))


def epoch_accuracy(batches: DataFrame) -> DataFrame:
    """Mean of the batch accuracies, weighted by the examples in a batch."""
    scored = batches.filter(F.col("accuracy").isNotNull())
    weighted = F.sum(F.col("accuracy") * F.col("n_examples"))
    return scored.agg(_ratio(weighted, F.sum("n_examples")).alias("accuracy"))


def example_results(pred: DataFrame, pad_id: int) -> DataFrame:
    """Hits and counted positions of each example."""
    named = pred.withColumn("domain", F.coalesce("domain", F.lit(UNKNOWN_DOMAIN)))
    return named.groupBy("example_id", "domain").agg(*hit_counts(pad_id))


def domain_accuracy(results: DataFrame) -> DataFrame:
    """Accuracy per domain from its summed counts; empty domains are left out.
    Partial sums are formed before the exchange, so a large domain is no
    heavier than a small one."""
    sums = results.groupBy("domain").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total")
    )
    return sums.filter(F.col("total") > 0).withColumn("accuracy", F.col("correct") / F.col("total"))


def domain_gap(results: DataFrame, first: str, second: str) -> DataFrame:
    """Absolute accuracy difference of two domains, null unless both have
    counted positions."""

    def accuracy(domain: str) -> Column:
        mine = F.col("domain") == domain
        correct = F.sum(F.when(mine, F.col("correct")))
        total = F.sum(F.when(mine, F.col("total")))
        return _ratio(correct, total)

    return results.agg(F.abs(accuracy(first) - accuracy(second)).alias("gap"))
