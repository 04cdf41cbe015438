"""Metrics of one validation pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.operators.batching import limit_batches
from millrace.operators.metrics import (
    batch_accuracy,
    domain_accuracy,
    domain_gap,
    epoch_accuracy,
    example_results,
    mean_loss,
    predictions,
)
from millrace.session import pin


@dataclass(frozen=True)
class Evaluation:
    loss: DataFrame
    accuracy: DataFrame
    by_domain: DataFrame
    gap: DataFrame


def evaluate(
    logits: DataFrame,
    pad_id: int,
    domains: tuple[str, str],
    smoothing: float = 0.1,
    max_batches: int | None = None,
) -> Evaluation:
    """Loss, epoch accuracy, accuracy per domain and the gap of two domains.

    The logits are read twice at most: once for the loss, once for predictions,
    which are small and are written down for the three accuracy tables.
    """
    if max_batches is not None:
        logits = limit_batches(logits, max_batches)
    pred = pin(predictions(logits), "predictions")
    results = example_results(pred, pad_id)
    return Evaluation(
        loss=mean_loss(logits, smoothing),
        accuracy=epoch_accuracy(batch_accuracy(pred, pad_id)),
        by_domain=domain_accuracy(results),
        gap=domain_gap(results, *domains),
    )
