"""Vector normalisation and periodic features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import table
from millrace.functions import vectors

WIDTH, RANK, OUT, SHARE = 64, 16, 20, 0.15
HOURS = 24.0


def _weights(rows: int, columns: int, offset: float) -> list[list[float]]:
    """Matrix ``cos(offset + 3 i + 7 j) / 2``, easy to repeat in SQL."""
    return [
        [math.cos(offset + 3 * i + 7 * j) / 2 for j in range(columns)] for i in range(rows)
    ]


def _flat(vector, digits: int = 6):
    return F.posexplode(F.transform(vector, lambda x: F.round(x, digits))).alias("i", "x")


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _flat(vectors.l2_normalize(F.col("embedding"))))


def rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _flat(vectors.rms_normalize(F.col("embedding"))))


def periodic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p_dim, plain_dim = vectors.periodic_dims(OUT, SHARE)
    features = vectors.periodic_features(
        a_p=_weights(RANK, WIDTH, 0.0),
        b_p=_weights(p_dim, RANK, 1.0),
        a_np=_weights(RANK, WIDTH, 2.0),
        b_np=_weights(plain_dim, RANK, 3.0),
        bias_np=[math.cos(4.0 + 3 * i) / 2 for i in range(plain_dim)],
    )
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", features(F.col("embedding")).alias("f")).select(
        "vec_id", _flat(F.col("f"))
    )


def hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos, sin = vectors.cos_sin(F.hour("ts"), HOURS)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(cos, 6).alias("cos_hour"), F.round(sin, 6).alias("sin_hour")
    )


def _product_sql(matrix_rows: int, vector: str, columns: int, offset: float) -> str:
    return (
        f"list_transform(range({matrix_rows}), lambda i: list_dot_product("
        f"list_transform(range({columns}), lambda j: cos({offset} + 3 * i + 7 * j) / 2), {vector}))"
    )


# The error function by its Maclaurin series: exact to double precision for the
# arguments that occur here (below 3), and independent of the tested code.
_GELU_TERMS = 60


def _gelu_sql(vector: str) -> str:
    x = "(v / sqrt(2))"
    # Term n is (-1)^n x^(2n+1) / (n! (2n+1)).
    series = (
        f"list_sum(list_transform(range({_GELU_TERMS}), lambda n: (1 - 2 * (n % 2)) "
        f"* pow({x}, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1))))"
    )
    return f"list_transform({vector}, lambda v: 0.5 * v * (1 + 2 / sqrt(pi()) * {series}))"


_P_DIM, _PLAIN_DIM = vectors.periodic_dims(OUT, SHARE)

QUERIES = {
    "l2_normalize": l2_normalize,
    "rms_normalize": rms_normalize,
    "periodic_features": periodic_features,
    "hour_features": hour_features,
}

_DOUBLES = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_SQUARES = "list_sum(list_transform(x, lambda e: e * e))"


def _unnested(vector: str, source: str) -> str:
    return (
        f"SELECT vec_id, CAST(unnest(range(len({vector}))) AS INTEGER) AS i, "
        f"round(unnest({vector}), 6) AS x FROM {source}"
    )


ORACLES = {
    "l2_normalize": f"""WITH {_DOUBLES}, n AS (
        SELECT vec_id, x, greatest(sqrt({_SQUARES}), 1e-12) AS s FROM v),
        u AS (SELECT vec_id, list_transform(x, lambda e: e / s) AS y FROM n)
        {_unnested("y", "u")}""",
    "rms_normalize": f"""WITH {_DOUBLES}, n AS (
        SELECT vec_id, x, sqrt({_SQUARES} / len(x) + 1e-5) AS s FROM v),
        u AS (SELECT vec_id, list_transform(x, lambda e: e / s) AS y FROM n)
        {_unnested("y", "u")}""",
    "periodic_features": f"""WITH {_DOUBLES},
        low AS (
            SELECT vec_id, {_product_sql(RANK, "x", WIDTH, 0.0)} AS lp,
                   {_product_sql(RANK, "x", WIDTH, 2.0)} AS ln
            FROM v),
        act AS (SELECT vec_id, {_gelu_sql("lp")} AS gp, {_gelu_sql("ln")} AS gn FROM low),
        proj AS (
            SELECT vec_id, {_product_sql(_P_DIM, "gp", RANK, 1.0)} AS p,
                   {_product_sql(_PLAIN_DIM, "gn", RANK, 3.0)} AS b
            FROM act),
        feats AS (
            SELECT vec_id, list_concat(list_concat(
                list_transform(p, lambda e: cos(e)), list_transform(p, lambda e: sin(e))),
                list_transform(b, lambda e, i: e + cos(4.0 + 3 * (i - 1)) / 2)) AS y
            FROM proj)
        {_unnested("y", "feats")}""",
    "hour_features": f"""SELECT event_id,
        round(cos(hour(ts) * 2 * pi() / {HOURS}), 6) AS cos_hour,
        round(sin(hour(ts) * 2 * pi() / {HOURS}), 6) AS sin_hour
        FROM events""",
}
