"""Line dedup across sites (DataFrame operations only).

A line's spread is the number of distinct sites it occurs on. HyperLogLog sketches of
the sites are built per line hash, within tasks first, and merged by aggregation, so a
line that a third of all documents share arrives as a few sketches. Lines whose
estimate is within ``BAND`` of the threshold get an exact distinct count; only lines that
reach the threshold are cross-site boilerplate and are removed from every document.

Defined results: a line is what stands between line feeds, without the spaces around it;
empty lines are never removed; a null text has no lines and stays null; a null site
counts as no site; equal documents keep or lose the same lines; an empty table gives an
empty table. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.operators.joining import join_lookup
from millrace.session import pin

LEAST_SITES = 5
BAND = 0.5
SKETCH_BITS = 8  # 256 registers, a standard error of 6 %


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread_lines(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES, band: float = BAND
) -> DataFrame:
    """``key`` of every line on at least ``least_sites`` sites, and ``sites``, the
    estimate, or the exact number for lines near the threshold."""
    seen = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("line")).where(
        F.trim("line") != ""
    )
    seen = seen.select("site", _key(F.col("line")).alias("key")).where(F.col("site").isNotNull())
    estimated = pin(
        seen.groupBy("key")
        .agg(F.min("site").alias("_a"), F.max("site").alias("_b"), F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"))
        # Most lines are on one site; that needs no estimate.
        .where((F.col("_a") != F.col("_b")) | F.lit(least_sites < 2))
        .where(F.col("sites") >= (1 - band) * least_sites)
        .select("key", "sites"),
        "line-spread",
    )
    near = estimated.where(F.col("sites") <= (1 + band) * least_sites).select("key")
    exact = seen.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("sites"))
    sure = estimated.where(F.col("sites") > (1 + band) * least_sites)
    return sure.unionByName(exact).where(F.col("sites") >= least_sites)


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    least_sites: int = LEAST_SITES,
    band: float = BAND,
) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_removed``."""
    docs, own, restored = W.aside(docs.drop("clean_text", "n_lines", "n_removed"), "_same", "_lost", "_kept")
    id_col, text_col, site_col = own(id_col), own(text_col), own(site_col)
    spread = pin(spread_lines(docs, text_col, site_col, least_sites, band).select("key", F.lit(True).alias("spread")), "spread-lines")
    # The documents' lines meet the spread lines, never the texts: what is joined back to
    # a document, by its id and text, is the set of keys it loses.
    same = F.xxhash64(F.col(id_col), F.col(text_col))
    keys = F.transform(_lines(F.col(text_col)), _key)
    met = docs.select(same.alias("_same"), F.explode(F.array_distinct(keys)).alias("key"))
    lost = (
        # One line may be on a third of all documents: where the spread lines are too many to
        # hand out, it is looked up under salts.
        join_lookup(met, spread, "key", "_same")
        .where("spread")
        .groupBy("_same")
        .agg(F.collect_set("key").alias("_lost"))
    )
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains("_lost", _key(x)) | (F.trim(x) == ""))
    return restored(
        docs.withColumn("_same", same)
        .join(lost, "_same", "left")
        .withColumns(
            {
                "_kept": F.when(F.col("_lost").isNull(), lines).otherwise(kept),
                "n_lines": F.coalesce(F.size(lines), F.lit(0)),
            }
        )
        .withColumns({"clean_text": F.array_join("_kept", "\n"), "n_removed": F.col("n_lines") - F.coalesce(F.size("_kept"), F.lit(0))})
        .withColumn("n_removed", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_removed")))
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")))
        .drop("_same", "_lost", "_kept")
    )
