"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees propose conjunctive rules (their paths); a logistic regression
with an L1 penalty weights them, which leaves a few dozen; those are compiled into one
Spark column expression over the statistics.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents (the smallest ids by
hash) outside the held-out fifth, in the driver; all documents are scored in place.

Defined results: null and empty texts have all statistics zero and are scored like any
other; null labels are not learned from; a document labelled twice counts with its
larger label; without labels, or with one class, the score is the mean label (0.5 if
there is none); repeated documents each get a row; an empty table gives an empty table.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.text_stats import NAMES, text_stats
from millrace.llm.trees import fit_boosted, fit_lasso_logistic

SAMPLE_ROWS = 20_000
HELD_OUT = 5  # one in so many
THRESHOLD = 0.3
TREES, DEPTH = 40, 3
PENALTY = 0.0005
STATS = "_stats"


def held_out(id_col: str, parts: int = HELD_OUT) -> Column:
    """Rows never learned from: by a checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out part, with ``y``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return (
        known.groupBy(F.col(id_col).alias("_labelled"))
        .agg(F.max(F.col(label_col)).cast("double").alias("y"))
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(rows)
    )


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array of statistics of each text."""

    def make():
        def work(texts: pa.Array) -> list:
            x = text_stats(texts)
            flat = pa.array(x.ravel(), pa.float64())
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)]

        return work

    return W.with_text_columns(docs, text_col, [T.StructField(STATS, T.ArrayType(T.DoubleType()))], make)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[list[tuple[int, bool, float]], float]]

    def column(self, stats: str = STATS) -> Column:
        """The score as a Spark expression over the array of statistics."""
        terms = [
            F.when(
                reduce(
                    lambda a, b: a & b,
                    [F.col(stats)[f] > t if above else F.col(stats)[f] <= t for f, above, t in conditions],
                ),
                F.lit(weight),
            ).otherwise(0.0)
            for conditions, weight in self.rules
        ]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))

    def __str__(self) -> str:
        return "\n".join(
            f"{w:+.3f}  " + " and ".join(f"{NAMES[f]} {'>' if above else '<='} {t:.4g}" for f, above, t in c)
            for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))
        )


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    if len(y) == 0 or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        return RuleEnsemble(float(np.log(mean / (1 - mean))), [])
    paths = fit_boosted(x, y, trees=TREES, depth=DEPTH, rate=0.2).paths()
    met = np.column_stack(
        [np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in path]) for path in paths]
    )
    _, first = np.unique(met, axis=1, return_index=True)
    share = met.mean(axis=0)
    kept = [k for k in sorted(first) if 0.002 <= share[k] <= 0.998]
    if not kept:
        return RuleEnsemble(float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4))), [])
    scale = met[:, kept].std(axis=0)
    intercept, weights = fit_lasso_logistic(met[:, kept] / scale, y, penalty)
    return RuleEnsemble(
        intercept, [(paths[k], float(w / s)) for k, w, s in zip(kept, weights, scale) if abs(w) > 1e-6]
    )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleEnsemble:
    sample = labelled_sample(labels, id_col, label_col, sample_rows)
    known = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(sample), F.col(id_col) == F.col("_labelled"))
    rows = with_stats(known, text_col).orderBy(id_col).select(STATS, "y").limit(2 * sample_rows).toArrow()
    x = rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return fit_rules(x, rows.column(1).to_numpy())


def classify(
    docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    docs, own, restored = W.aside(docs.drop("held_out", "score", "predicted"), STATS)
    return restored(
        with_stats(docs, own(text_col))
        .withColumn("score", model.column())
        .withColumns({"held_out": held_out(own(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
        .drop(STATS)
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those the classifier rejects."""
    model = fit(docs, labels, id_col, text_col)
    docs, own, restored = W.aside(docs, STATS)
    return restored(with_stats(docs, own(text_col)).where(model.column() >= THRESHOLD).drop(STATS))
