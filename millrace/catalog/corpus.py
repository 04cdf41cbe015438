"""Cleaning, filtering, quotas, ids, counts and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import (
    CLEANED_CTE,
    EDGES,
    EXAMPLES_CTE,
    MATH,
    MIN_WORDS,
    RAW_MATH,
    RAW_WEB,
    WEB,
    WORDS_SQL,
    examples,
    math_rows,
    math_sql,
    noisy,
    raw_sql,
    sources,
    table,
    web_rows,
    web_sql,
)
from millrace.config import source_quotas
from millrace.functions.cleaning import clean_and_keep, math_clean, web_clean, word_count
from millrace.operators import reports
from millrace.operators.quota import union_sources
from millrace.session import scratch_path, spread
from millrace.sources.text import read_jsonl, write_jsonl
from millrace.streaming.clean_stream import read_numbered, read_progress, start_numbered_sink

QUOTA_RATIO = 0.65
ARRIVALS = 4
DATE = "2024-01-01"
FACTS = {"source": "documents", "additional_source": "conversations", "original_license": "none"}
LABELS = {WEB: "Web", MATH: "Math"}


def clean_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(web_rows(spark, sf_dir), "ord")
    return rows.select("ord", web_clean(F.col("text")).alias("text"))


def clean_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(math_rows(spark, sf_dir), "ord")
    return rows.select("ord", math_clean(F.col("text")).alias("text"))


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        "page_id",
        web_clean(F.col("html")).alias("as_web"),
        math_clean(F.col("html")).alias("as_math"),
    )


def keep_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean_and_keep(spread(web_rows(spark, sf_dir), "ord"), web_clean, MIN_WORDS)
    return kept.select("ord", "text", word_count(F.col("text")).cast("bigint").alias("n_words"))


def language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.expr(noisy("doc_id")).alias("text")
    )
    kept = clean_and_keep(spread(rows, "doc_id"), web_clean, MIN_WORDS)
    return kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(word_count(F.col("text"))).alias("n_words"),
    )


def quota_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = sources(spark, sf_dir)
    total = sum(s.rows.count() for s in pair) // 2
    return union_sources(pair, source_quotas(total, [QUOTA_RATIO]), MIN_WORDS)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_counts(examples(spark, sf_dir))


def mix_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mix_ratio(examples(spark, sf_dir))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attribution(examples(spark, sf_dir), FACTS, LABELS, MIN_WORDS, DATE)


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    write_jsonl(examples(spark, sf_dir), path)
    return read_jsonl(spark, path)


def _as_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .parquet(path)
        .select(F.col("doc_id").alias("ord"), F.expr(noisy("doc_id")).alias("text"))
    )


def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, which a stream takes for one file as well as for a folder of files.
    stream = _as_stream(spark, f"{sf_dir}/documents.parque[t]", schema)
    out = scratch_path(spark, "stream")
    start_numbered_sink(stream, web_clean, WEB, ["ord"], out, min_words_exclusive=MIN_WORDS).awaitTermination()
    return read_numbered(spark, out).drop("batch")


def _streamed_with_quota(spark: SparkSession, sf_dir: str) -> str:
    """The documents arrive in ``ARRIVALS`` folders by id, and half of their number is wanted:
    the quota ends within an arrival. After each, what is there is streamed, as one batch
    whatever its number of files."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    step, arrivals, out = -(-n // ARRIVALS), scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    for k in range(ARRIVALS):
        part = docs.filter(F.least(F.expr(f"doc_id div {step}"), F.lit(ARRIVALS - 1)) == k)
        part.write.parquet(f"{arrivals}/{k}")
        stream = _as_stream(spark, f"{arrivals}/*", docs.schema)
        start_numbered_sink(stream, web_clean, WEB, ["ord"], out, n // 2, MIN_WORDS).awaitTermination()
    return out


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_numbered(spark, _streamed_with_quota(spark, sf_dir))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_progress(spark, _streamed_with_quota(spark, sf_dir))


def share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    report = reports.share_report(table(spark, sf_dir, "orders"), "o_orderpriority", cents)
    return report.withColumn("pct", F.round("pct", 6))


QUERIES = {
    "clean_web": clean_web,
    "clean_math": clean_math,
    "clean_html": clean_html,
    "keep_long": keep_long,
    "language_words": language_words,
    "quota_ids": quota_ids,
    "source_counts": source_counts,
    "mix_ratio": mix_ratio,
    "attribution": attribution,
    "jsonl_roundtrip": jsonl_roundtrip,
    "stream_clean": stream_clean,
    "stream_quota": stream_quota,
    "stream_progress": stream_progress,
    "share_report": share_report,
}

_N_WEB = f"count(*) FILTER (domain = '{WEB}')"
_N_MATH = f"count(*) FILTER (domain = '{MATH}')"

_ARRIVED = f"""size AS (SELECT count(*) AS n, -(-count(*) // {ARRIVALS}) AS step FROM documents),
arrived AS (
    SELECT ord, {web_sql("text")} AS text, CAST(least(ord // step, {ARRIVALS - 1}) AS INTEGER) AS batch
    FROM {raw_sql("documents", "doc_id", "doc_id", edges=False)} AS r, size),
accepted AS (
    SELECT *, row_number() OVER (ORDER BY ord) - 1 AS idx FROM arrived WHERE {WORDS_SQL} > {MIN_WORDS})"""

ORACLES = {
    "stream_quota": f"""WITH {_ARRIVED}
        SELECT '{WEB}_' || idx AS id, '{WEB}' AS domain, text, idx, batch
        FROM accepted, size WHERE idx < n // 2""",
    "stream_progress": f"""WITH {_ARRIVED},
        per AS (SELECT batch, count(*) AS seen FROM arrived GROUP BY batch),
        acc AS (SELECT batch, count(*) AS kept FROM accepted GROUP BY batch),
        b AS (
            SELECT batch, seen, coalesce(kept, 0) AS kept,
                   coalesce(CAST(sum(kept) OVER (ORDER BY batch) AS BIGINT), 0) - coalesce(kept, 0) AS before
            FROM per LEFT JOIN acc USING (batch))
        SELECT batch, CASE WHEN before < n // 2 THEN seen ELSE 0 END AS seen,
               CASE WHEN before < n // 2 THEN kept ELSE 0 END AS kept,
               greatest(least(kept, n // 2 - before), 0) AS written
        FROM b, size""",
    "clean_web": f"SELECT ord, {web_sql('text')} AS text FROM {RAW_WEB} AS r",
    "clean_math": f"SELECT ord, {math_sql('text')} AS text FROM {RAW_MATH} AS r",
    "clean_html": f"""SELECT page_id, {web_sql('html')} AS as_web, {math_sql('html')} AS as_math
        FROM pages""",
    "keep_long": f"""WITH {CLEANED_CTE}
        SELECT ord, text, CAST({WORDS_SQL} AS BIGINT) AS n_words
        FROM cleaned WHERE domain = '{WEB}' AND {WORDS_SQL} > {MIN_WORDS}""",
    "language_words": f"""WITH c AS (
            SELECT lang, {web_sql(noisy('doc_id'))} AS text FROM documents)
        SELECT lang, count(*) AS n_docs, CAST(sum({WORDS_SQL}) AS BIGINT) AS n_words
        FROM c WHERE {WORDS_SQL} > {MIN_WORDS} GROUP BY lang""",
    "quota_ids": f"""WITH {CLEANED_CTE},
        size AS (SELECT ((SELECT count(*) FROM documents)
                 + (SELECT count(*) FROM conversations) + {2 * len(EDGES)}) // 2 AS total),
        quota AS (SELECT total, CAST(floor(total * CAST({QUOTA_RATIO} AS DOUBLE)) AS BIGINT) AS q
                  FROM size),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS idx
            FROM cleaned WHERE {WORDS_SQL} > {MIN_WORDS}),
        taken AS (
            SELECT n.* FROM numbered n, quota
            WHERE idx < CASE WHEN source_no = 0 THEN q ELSE total - q END)
        SELECT domain || '_' || idx AS id, domain, text,
               CAST(row_number() OVER (ORDER BY source_no, ord) - 1 AS BIGINT) AS pos
        FROM taken""",
    "source_counts": f"""WITH {EXAMPLES_CTE}
        SELECT domain, count(*) AS n FROM examples GROUP BY domain""",
    "mix_ratio": f"""WITH {EXAMPLES_CTE}
        SELECT domain, count(*) AS n,
               round(100.0 * count(*) / (SELECT count(*) FROM examples), 1)::DOUBLE AS pct
        FROM examples GROUP BY domain""",
    "attribution": f"""WITH {EXAMPLES_CTE}
        SELECT {", ".join(f"'{v}' AS {k}" for k, v in FACTS.items())},
               printf('%.1f%% {LABELS[WEB]}, %.1f%% {LABELS[MATH]}',
                      {_N_WEB}::DOUBLE / count(*) * 100, {_N_MATH}::DOUBLE / count(*) * 100)
                   AS mix_ratio,
               count(*) AS processed_examples, '{DATE}' AS processing_date,
               {MIN_WORDS} AS min_words_exclusive
        FROM examples""",
    "jsonl_roundtrip": f"WITH {EXAMPLES_CTE} SELECT id, domain, text, pos FROM examples",
    "stream_clean": f"""WITH c AS (
            SELECT ord, {web_sql("text")} AS text
            FROM {raw_sql("documents", "doc_id", "doc_id", edges=False)} AS r),
        n AS (SELECT text, row_number() OVER (ORDER BY ord) - 1 AS idx FROM c
              WHERE {WORDS_SQL} > {MIN_WORDS})
        SELECT '{WEB}_' || idx AS id, '{WEB}' AS domain, text, idx FROM n""",
    "share_report": """WITH g AS (
            SELECT o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT)
                AS total
            FROM orders GROUP BY o_orderpriority)
        SELECT o_orderpriority, total,
               round(total::DOUBLE / (SELECT sum(total) FROM g) * 100, 6) AS pct
        FROM g""",
}
