"""Shuffle, stratified split and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import EXAMPLES_CTE, MATH, SEED, VAL_RATIO, WEB, examples
from millrace.operators import shuffling, splitting
from millrace.operators.reports import domain_stats as stats_of
from millrace.operators.reports import domain_stats_wide as widened


def split_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.stratified_split(examples(spark, sf_dir), VAL_RATIO, SEED)


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffling.seeded_shuffle(examples(spark, sf_dir), SEED).select(
        "id", "domain", "text", "shuffle_pos"
    )


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_positions(split_examples(spark, sf_dir), SEED).select(
        "id", "domain", "split", "split_pos"
    )


def split_is_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in both splits and rows in neither: both must be none."""
    rows = examples(spark, sf_dir)
    marked = splitting.stratified_split(rows, VAL_RATIO, SEED)
    ids = {
        s: marked.filter(F.col("split") == s).select("id")
        for s in (splitting.TRAIN, splitting.VALIDATION)
    }
    both = ids[splitting.TRAIN].intersect(ids[splitting.VALIDATION])
    either = ids[splitting.TRAIN].union(ids[splitting.VALIDATION])
    lost = rows.select("id").subtract(either)
    return both.select(F.lit("both").alias("problem"), "id").union(
        lost.select(F.lit("neither"), "id")
    ).groupBy().agg(F.count("id").alias("n_problems"))


def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(split_examples(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def domain_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = widened(stats_of(split_examples(spark, sf_dir)), [WEB, MATH])
    for d in (WEB, MATH):
        wide = wide.withColumn(f"{d}_percent", F.round(f"{d}_percent", 6))
    return wide


SPLIT_CTE = f"""{EXAMPLES_CTE},
per_domain AS (SELECT domain, count(*) AS n FROM examples GROUP BY domain),
want AS (
    SELECT CAST(ceil(CAST({VAL_RATIO} AS DOUBLE) * sum(n)) AS HUGEINT) AS want,
           CAST(sum(n) AS HUGEINT) AS everything
    FROM per_domain),
shares AS (
    SELECT domain, n, want, want * n // everything AS base, want * n % everything AS rest
    FROM per_domain, want),
quotas AS (
    SELECT domain, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, domain)
               <= want - sum(base) OVER () THEN 1 ELSE 0 END AS n_val
    FROM shares),
ranked AS (
    SELECT e.*, row_number() OVER (PARTITION BY e.domain
               ORDER BY md5('{SEED}:split:' || e.id), e.id) AS place
    FROM examples e),
marked AS (
    SELECT r.id, r.domain, r.text, r.pos,
           CASE WHEN place <= n_val THEN 'validation' ELSE 'train' END AS split
    FROM ranked r JOIN quotas USING (domain)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY split
               ORDER BY md5('{SEED}:order:' || id), id) - 1 AS split_pos
    FROM marked)"""

_STATS = """stats AS (
    SELECT split, domain, n, n / sum(n) OVER (PARTITION BY split) * 100 AS pct
    FROM (SELECT split, domain, count(*) AS n FROM marked GROUP BY split, domain))"""

QUERIES = {
    "seeded_shuffle": seeded_shuffle,
    "stratified_split": stratified_split,
    "split_is_partition": split_is_partition,
    "domain_stats": domain_stats,
    "domain_stats_wide": domain_stats_wide,
}

ORACLES = {
    "seeded_shuffle": f"""WITH {EXAMPLES_CTE}
        SELECT id, domain, text,
               row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1 AS shuffle_pos
        FROM examples""",
    "stratified_split": f"WITH {SPLIT_CTE} SELECT id, domain, split, split_pos FROM placed",
    "split_is_partition": f"""WITH {SPLIT_CTE}, sides AS (
            SELECT id FROM marked WHERE split = 'train'
            INTERSECT SELECT id FROM marked WHERE split = 'validation')
        SELECT (SELECT count(*) FROM sides) + (SELECT count(*) FROM
            (SELECT id FROM examples EXCEPT SELECT id FROM marked)) AS n_problems""",
    "domain_stats": f"""WITH {SPLIT_CTE}, {_STATS}
        SELECT split, domain, n, round(pct::DOUBLE, 6) AS pct FROM stats""",
    "domain_stats_wide": f"""WITH {SPLIT_CTE}, {_STATS}
        SELECT split,
        {", ".join(
            f"coalesce(CAST(sum(n) FILTER (domain = '{d}') AS BIGINT), 0) AS {d}_count, "
            f"round(coalesce(sum(pct::DOUBLE) FILTER (domain = '{d}'), 0), 6) AS {d}_percent"
            for d in (WEB, MATH))}
        FROM stats GROUP BY split""",
}
