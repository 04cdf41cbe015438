"""Vector normalisation and periodic features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let
from millrace.functions.logits import as_double

MAX_WEIGHTS = 16_000_000


def _sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalize(vector: Column, eps: float = 1e-12) -> Column:
    return let(
        as_double(vector),
        lambda v: let(
            F.greatest(F.sqrt(_sum_of_squares(v)), F.lit(eps)),
            lambda norm: F.transform(v, lambda x: x / norm),
        ),
    )


def rms_normalize(
    vector: Column, eps: float = 1e-5, gain: Sequence[float] | None = None
) -> Column:
    unit = let(
        as_double(vector),
        lambda v: let(
            F.sqrt(_sum_of_squares(v) / F.size(v) + F.lit(eps)),
            lambda rms: F.transform(v, lambda x: x / rms),
        ),
    )
    if gain is None:
        return unit
    weights = F.array(*[F.lit(float(g)) for g in gain])
    return F.zip_with(unit, weights, lambda x, g: x * g)


def periodic_dims(out_features: int, p: float) -> tuple[int, int]:
    """Width of the cosine (and of the sine) part, and of the plain part."""
    periodic = int(out_features * p)
    return periodic, out_features - 2 * periodic


def cos_sin(x: Column, period: float) -> tuple[Column, Column]:
    """Cosine and sine of a numeric column with the given period."""
    angle = x * F.lit(2.0 * math.pi / period)
    return F.cos(angle), F.sin(angle)


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function of whole arrays: the series of positive terms
    2/sqrt(pi) exp(-x^2) x sum((2 x^2)^n / (1 3 5 ... (2n+1))), which loses no digits.
    Beyond 6 the function is 1 in double precision."""
    a = np.minimum(np.abs(x), 6.0)
    square = 2.0 * a * a
    term = np.ones_like(a)
    total = np.ones_like(a)
    n = 0
    while term.size and term.max() > 1e-17 * total.max():
        n += 1
        term *= square / (2 * n + 1)
        total += term
    return np.sign(x) * np.minimum(2.0 / math.sqrt(math.pi) * np.exp(-a * a) * a * total, 1.0)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)))


def periodic_features(
    a_p: Sequence[Sequence[float]],
    b_p: Sequence[Sequence[float]],
    a_np: Sequence[Sequence[float]],
    b_np: Sequence[Sequence[float]],
    bias_np: Sequence[float],
) -> Callable[[Column], Column]:
    """Features ``[cos(P), sin(P), N]`` of a vector column, with P and N
    low-rank projections ``B gelu(A x)`` under the supplied weights (matrices
    as rows of output units). N has a bias, P has none.

    The weights travel with the function, hence the bound on their size.
    """
    ap, bp, an, bn = (np.asarray(m, dtype=float) for m in (a_p, b_p, a_np, b_np))
    bias = np.asarray(bias_np, dtype=float)
    n_weights = sum(m.size for m in (ap, bp, an, bn, bias))
    if n_weights > MAX_WEIGHTS:
        raise ValueError(f"{n_weights} weights exceed the limit of {MAX_WEIGHTS}")

    @F.pandas_udf("array<double>")
    def features(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        known = vectors.notna()
        if known.any():
            x = np.stack(vectors[known].to_numpy()).astype(float)
            periodic = _gelu(x @ ap.T) @ bp.T
            plain = _gelu(x @ an.T) @ bn.T + bias
            rows = np.hstack([np.cos(periodic), np.sin(periodic), plain])
            out[known] = pd.Series(list(rows), index=vectors.index[known])
        return out

    return features
