"""Expressions over one array of logits per row, computed in double.

Each expression is linear in the array (top-k adds one sort), so a row costs
what its vocabulary costs and nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let


def as_double(z: Column) -> Column:
    return z.cast("array<double>")


def _sum(z: Column) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x)


def scaled(z: Column, temperature: float) -> Column:
    """Divide by the temperature; a temperature of 0 or less means 1."""
    t = float(temperature) if temperature > 0 else 1.0
    return F.transform(as_double(z), lambda x: x / F.lit(t))


def log_sum_exp(z: Column) -> Column:
    return let(
        as_double(z),
        lambda v: let(
            F.array_max(v),
            lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))),
        ),
    )


def softmax(z: Column) -> Column:
    shifted = let(
        as_double(z),
        lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))),
    )
    return let(shifted, lambda e: let(_sum(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax_token(z: Column) -> Column:
    """0-based position of the first maximum."""
    return let(z, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def smoothed_loss(z: Column, target: Column, smoothing: float = 0.1) -> Column:
    """Cross entropy of one row against a label-smoothed target."""
    return let(
        as_double(z),
        lambda v: log_sum_exp(v)
        - F.lit(1.0 - smoothing) * F.element_at(v, target + 1)
        - F.lit(smoothing) * _sum(v) / F.size(v),
    )


def is_hit(predicted: Column, target: Column, pad_id: int) -> Column:
    return (predicted == target) & (target != pad_id)


def ranked_tokens(z: Column) -> Column:
    """(neg, tok) structs from the largest logit down; the lower token first
    among equals."""
    pairs = F.transform(as_double(z), lambda x, i: F.struct((-x).alias("neg"), i.alias("tok")))
    return F.sort_array(pairs)


def top_k_survivors(ranked: Column, k: int) -> Column:
    """Ranked tokens whose logit reaches the k-th largest one; ties stay and
    ``k <= 0`` keeps everything."""
    if k <= 0:
        return ranked
    return let(
        ranked,
        lambda r: let(
            F.element_at(r, F.least(F.lit(k), F.size(r)))["neg"],
            lambda cut: F.filter(r, lambda s: s["neg"] <= cut),
        ),
    )


def survivor_probabilities(ranked: Column) -> Column:
    """Softmax over ranked survivors, in the same order."""
    return softmax(F.transform(ranked, lambda s: -s["neg"]))


def _mass_prefix(p: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """How many entries satisfy ``keep(mass before, mass with)``, a condition
    that holds for a prefix only."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        mass = acc["mass"] + x
        n = acc["n"] + F.when(keep(acc["mass"], mass), F.lit(1)).otherwise(F.lit(0))
        return F.struct(mass.alias("mass"), n.alias("n"))

    return F.aggregate(p, start, step, lambda acc: acc["n"])


def top_p_survivors(ranked: Column, p: float) -> Column:
    """Ranked tokens before which the probability mass is at most ``p``: the
    first always stays, so does the one that crosses; ``p <= 0`` is off."""
    if p <= 0:
        return ranked
    return let(
        ranked,
        lambda r: F.slice(
            r,
            F.lit(1),
            _mass_prefix(survivor_probabilities(r), lambda before, _: before <= F.lit(p)),
        ),
    )


def draw_token(ranked: Column, u: Column) -> Column:
    """Token whose slice of the cumulative probability contains ``u``."""
    return let(
        ranked,
        lambda r: F.element_at(
            r,
            F.least(
                _mass_prefix(survivor_probabilities(r), lambda _, upto: upto <= u) + 1,
                F.size(r),
            ),
        )["tok"],
    )
