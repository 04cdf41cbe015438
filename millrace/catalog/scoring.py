"""Loss, accuracy, and next-token sampling over a table of logits.

The embeddings serve as logits (64 wide) with the label as target; four rows
make an example, sixteen a batch, and label 9 plays the pad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import MATH, SEED, WEB, table
from millrace.functions.logits import smoothed_loss as loss_of
from millrace.operators import metrics, sampling
from millrace.plans.evaluate import evaluate
from millrace.session import pin, scratch_path
from millrace.streaming.epoch_metrics import fold, read_batch_accuracy, read_domain_accuracy, start_epoch_sink

PAD_ID = 9
SMOOTHING = 0.1
TOP_K, TOP_P, TEMPERATURE, STEP = 10, 0.85, 0.9, 1
ARRIVALS = 3


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    domain = (
        F.when(label % 3 == 0, F.lit(WEB)).when(label % 3 == 1, F.lit(MATH))
    )
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 16").alias("batch_id"),
        F.expr("vec_id div 4").alias("example_id"),
        domain.alias("domain"),
        (F.col("vec_id") % 4).alias("pos"),
        F.col("embedding").alias("logits"),
        label.alias("target"),
        "vec_id",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions folded onto the ten labels, so that some of them hit."""
    pred = metrics.predictions(logits(spark, sf_dir))
    return pred.withColumn("predicted", F.col("predicted") % 10)


def argmax_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.predictions(logits(spark, sf_dir)).select("vec_id", "predicted")


def smoothed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = loss_of(F.col("logits"), F.col("target"), SMOOTHING)
    return logits(spark, sf_dir).select("vec_id", F.round(loss, 6).alias("loss"))


def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_loss(logits(spark, sf_dir), SMOOTHING).withColumn(
        "loss", F.round("loss", 6)
    )


def mean_loss_without_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_loss(logits(spark, sf_dir), SMOOTHING, PAD_ID).withColumn(
        "loss", F.round("loss", 6)
    )


def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.batch_accuracy(predictions(spark, sf_dir), PAD_ID)
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def epoch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.epoch_accuracy(metrics.batch_accuracy(predictions(spark, sf_dir), PAD_ID))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def example_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.example_results(predictions(spark, sf_dir), PAD_ID)


def domain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.domain_accuracy(example_results(spark, sf_dir))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def domain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.domain_gap(example_results(spark, sf_dir), WEB, MATH)
    return rows.withColumn("gap", F.round("gap", 6))


def _epoch_by_arrivals(spark: SparkSession, sf_dir: str) -> str:
    """The predictions arrive in ``ARRIVALS`` parts that cut through examples and batches; all but the
    last are folded together before it comes."""
    pred = pin(predictions(spark, sf_dir).drop("vec_id").withColumn("arrival", (F.col("pos") + F.col("batch_id")) % ARRIVALS), "predictions")
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "epoch")
    for k in range(ARRIVALS):
        pred.where(F.col("arrival") == k).drop("arrival").write.parquet(f"{arrivals}/{k}")
        stream = spark.readStream.schema(pred.drop("arrival").schema).parquet(f"{arrivals}/*")
        start_epoch_sink(stream, out, PAD_ID).awaitTermination()
        if k == ARRIVALS - 2:
            fold(spark, out)
    return out


def epoch_domain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_domain_accuracy(spark, _epoch_by_arrivals(spark, sf_dir))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def epoch_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_batch_accuracy(spark, _epoch_by_arrivals(spark, sf_dir))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables of one validation pass as one list of figures."""
    done = evaluate(logits(spark, sf_dir), PAD_ID, (WEB, MATH), SMOOTHING)

    def figure(df: DataFrame, name, value: str) -> DataFrame:
        return df.select(name.alias("name"), F.round(value, 6).alias("value"))

    return (
        figure(done.loss, F.lit("loss"), "loss")
        .union(figure(done.accuracy, F.lit("accuracy"), "accuracy"))
        .union(figure(done.by_domain, F.concat(F.lit("accuracy_"), "domain"), "accuracy"))
        .union(figure(done.gap, F.lit("gap"), "gap"))
    )


def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, top_k=TOP_K, top_p=0.0)


def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, top_k=0, top_p=TOP_P)


def top_k_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, top_k=TOP_K, top_p=TOP_P)


def _survivors(spark: SparkSession, sf_dir: str, top_k: int, top_p: float) -> DataFrame:
    rows = sampling.surviving_tokens(
        logits(spark, sf_dir), "vec_id", top_k, top_p, TEMPERATURE
    )
    return rows.select("vec_id", "tok", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


def long_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter on a table with one row per token."""
    tokens = logits(spark, sf_dir).select(
        F.col("vec_id").alias("row_id"), F.posexplode("logits").alias("tok", "z")
    )
    scaled = tokens.withColumn("z", F.col("z").cast("double") / TEMPERATURE)
    kept = sampling.long_top_p(sampling.long_top_k(scaled, TOP_K), TOP_P)
    return kept.select("row_id", "tok", F.round("z", 6).alias("z"))


def sample_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.sample_next_token(
        logits(spark, sf_dir), "vec_id", SEED, STEP, TOP_K, TOP_P, TEMPERATURE
    )
    return rows.select("vec_id", "token")


_LOGITS = f"""logits AS (
    SELECT vec_id, vec_id // 16 AS batch_id, vec_id // 4 AS example_id,
           CASE label % 3 WHEN 0 THEN '{WEB}' WHEN 1 THEN '{MATH}' END AS domain,
           CAST(embedding AS DOUBLE[]) AS z, label AS target
    FROM embeddings)"""

_LOSS = f"""{_LOGITS},
losses AS (
    SELECT vec_id, target,
           list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))
           - {1 - SMOOTHING} * z[target + 1] - {SMOOTHING} * list_sum(z) / len(z) AS loss
    FROM logits)"""

_PRED = f"""{_LOGITS},
pred AS (
    SELECT batch_id, example_id, coalesce(domain, 'unknown') AS domain, target,
           (list_position(z, list_max(z)) - 1) % 10 AS predicted
    FROM logits),
hits AS (
    SELECT *, CAST(predicted = target AND target <> {PAD_ID} AS BIGINT) AS hit,
           CAST(target <> {PAD_ID} AS BIGINT) AS counted
    FROM pred),
batches AS (
    SELECT batch_id, CAST(sum(hit) AS BIGINT) AS correct, CAST(sum(counted) AS BIGINT) AS total,
           count(DISTINCT example_id) AS n_examples,
           CASE WHEN sum(counted) > 0 THEN sum(hit) / sum(counted)::DOUBLE END AS accuracy
    FROM hits GROUP BY batch_id),
results AS (
    SELECT example_id, domain, CAST(sum(hit) AS BIGINT) AS correct,
           CAST(sum(counted) AS BIGINT) AS total
    FROM hits GROUP BY example_id, domain),
by_domain AS (
    SELECT domain, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total,
           sum(correct) / sum(total)::DOUBLE AS accuracy
    FROM results GROUP BY domain HAVING sum(total) > 0),
gap AS (
    SELECT abs((SELECT accuracy FROM by_domain WHERE domain = '{WEB}')
             - (SELECT accuracy FROM by_domain WHERE domain = '{MATH}')) AS gap),
epoch AS (
    SELECT sum(accuracy * n_examples) / sum(n_examples) AS accuracy
    FROM batches WHERE accuracy IS NOT NULL)"""


def _filter_cte(top_k: int, top_p: float) -> str:
    """CTE ``kept``: vec_id, tok, z, renormalised p."""
    k_test = f"place <= {top_k}" if top_k > 0 else "true"
    p_test = f"mass - q <= {top_p} OR first = 1" if top_p > 0 else "true"
    return f"""{_LOGITS},
scaled AS (
    SELECT vec_id, CAST(unnest(range(len(z))) AS INTEGER) AS tok,
           unnest(z) / {TEMPERATURE} AS z FROM logits),
ranked AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY z DESC) AS place FROM scaled),
top AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM ranked WHERE {k_test}),
weighted AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM top),
massed AS (
    SELECT *, sum(q) OVER w AS mass, row_number() OVER w AS first FROM weighted
    WINDOW w AS (PARTITION BY vec_id ORDER BY z DESC, tok
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (
    SELECT vec_id, tok, z, e / sum(e) OVER (PARTITION BY vec_id) AS p
    FROM massed WHERE {p_test})"""


def _filter_sql(top_k: int, top_p: float) -> str:
    return f"""WITH {_filter_cte(top_k, top_p)}
        SELECT vec_id, tok, round(z, 6) AS z, round(p, 6) AS p FROM kept"""


QUERIES = {
    "argmax_tokens": argmax_tokens,
    "smoothed_loss": smoothed_loss,
    "mean_loss": mean_loss,
    "mean_loss_without_pad": mean_loss_without_pad,
    "token_accuracy": token_accuracy,
    "epoch_accuracy": epoch_accuracy,
    "example_results": example_results,
    "domain_accuracy": domain_accuracy,
    "domain_gap": domain_gap,
    "evaluation": evaluation,
    "top_k_filter": top_k_filter,
    "top_p_filter": top_p_filter,
    "top_k_top_p": top_k_top_p,
    "epoch_domain_accuracy": epoch_domain_accuracy,
    "epoch_token_accuracy": epoch_token_accuracy,
    "long_filter": long_filter,
    "sample_token": sample_token,
}

_MEAN_LOSS = "SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM losses"

ORACLES = {
    "argmax_tokens": f"""WITH {_LOGITS}
        SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted
        FROM logits""",
    "smoothed_loss": f"WITH {_LOSS} SELECT vec_id, round(loss, 6) AS loss FROM losses",
    "mean_loss": f"WITH {_LOSS} {_MEAN_LOSS}",
    "mean_loss_without_pad": f"WITH {_LOSS} {_MEAN_LOSS} WHERE target <> {PAD_ID}",
    "token_accuracy": f"""WITH {_PRED}
        SELECT batch_id, correct, total, n_examples, round(accuracy, 6) AS accuracy
        FROM batches""",
    "epoch_accuracy": f"WITH {_PRED} SELECT round(accuracy, 6) AS accuracy FROM epoch",
    "example_results": f"WITH {_PRED} SELECT example_id, domain, correct, total FROM results",
    "domain_accuracy": f"""WITH {_PRED}
        SELECT domain, correct, total, round(accuracy, 6) AS accuracy FROM by_domain""",
    "domain_gap": f"WITH {_PRED} SELECT round(gap, 6) AS gap FROM gap",
    "evaluation": "",
    "top_k_filter": _filter_sql(TOP_K, 0.0),
    "top_p_filter": _filter_sql(0, TOP_P),
    "top_k_top_p": _filter_sql(TOP_K, TOP_P),
    "long_filter": f"""WITH {_filter_cte(TOP_K, TOP_P)}
        SELECT vec_id AS row_id, tok, round(z, 6) AS z FROM kept""",
    "sample_token": f"""WITH {_filter_cte(TOP_K, TOP_P)},
        drawn AS (
            SELECT vec_id, tok, sum(p) OVER w AS upto, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY vec_id) AS n,
                   CAST('0x' || substr(md5('{SEED}:' || vec_id || ':{STEP}'), 1, 8) AS BIGINT)
                       / {float(16**8)} AS u
            FROM kept WINDOW w AS (PARTITION BY vec_id ORDER BY z DESC, tok
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT vec_id, arg_min(tok, place) AS token FROM drawn
        WHERE upto > u OR place = n GROUP BY vec_id""",
}

ORACLES["epoch_domain_accuracy"] = ORACLES["domain_accuracy"]
ORACLES["epoch_token_accuracy"] = ORACLES["token_accuracy"]
_UNFOLDED = _PRED.replace("(list_position(z, list_max(z)) - 1) % 10", "list_position(z, list_max(z)) - 1")
ORACLES["evaluation"] = f"""WITH {_UNFOLDED},
    {_LOSS[len(_LOGITS) + 1:]}
    SELECT 'loss' AS name, round(avg(loss), 6) AS value FROM losses
    UNION ALL SELECT 'accuracy', round(accuracy, 6) FROM epoch
    UNION ALL SELECT 'accuracy_' || domain, round(accuracy, 6) FROM by_domain
    UNION ALL SELECT 'gap', round(gap, 6) FROM gap"""
