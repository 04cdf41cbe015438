"""Mix sources to target weights (DataFrame operations only).

Every source gets a share of the budget by its weight, at most ``cap`` times its
own size; what a capped source leaves is shared again by weight. A source whose
target exceeds its size is taken whole for as many complete epochs as fit; the
rest is a weighted sample without replacement (Efraimidis and Spirakis): each
document draws the exponential key ``-ln(u) / quality`` from a hash of itself,
and documents are taken in ascending key order while the middle of the document
lies within the remaining budget.

The order is never produced by sorting a source. Logarithms of the keys fall into
bins; sizes are summed by (source, bin), then once more within the one bin the
budget ends in, so only a few millionths of a source meet in a window.

Defined results: a null or empty text has size 0; a null source is a source of its
own, last in order; a null, non-positive or non-finite quality counts as
``LEAST_QUALITY``; equal rows have equal keys and are told apart arbitrarily, so
which of them is taken does not show; a source of size 0 has target 0; an empty
table gives an empty table. Columns of the input named like a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.session import pin

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20
LEAST_QUALITY = 1e-6
BINS_PER_UNIT = 512  # of the keys' natural logarithm; a unit holds at most 37 % of a source
RESULT = ("size", "source_size", "target", "taken", "copies")
PLACES = ("_mix_source", "_mix_at", "_mix_bin", "_mix_sub")
OWN = (*PLACES, "_s", "_t", "_target", "_epochs", "_rest", "_cut_bin", "_cut_left", "_sub_bin", "_sub_left", "_in", "_before")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A cheap quality weight in (0, 1]: near 1 for a mean word length usual in
    prose, falling as words get much shorter or longer."""
    mean = F.try_divide((F.length(text) - size + 1).cast("double"), size)
    return F.coalesce(F.exp(-F.abs(F.log(mean / 5.5))), F.lit(LEAST_QUALITY))


def sized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with the size, source and place in key order of every row."""
    size = F.col("size")
    out = docs.drop(*RESULT).withColumn("size", word_count(F.col(text_col)))
    weight = text_quality(F.col(text_col), size) if quality is None else quality
    weight = weight.cast("double")
    sound = weight.isNotNull() & ~F.isnan(weight) & (weight > 0) & (weight < float("inf"))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    u = (F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(2.0**53)
    key = -F.log(u) / F.when(sound, F.greatest(weight, F.lit(LEAST_QUALITY))).otherwise(LEAST_QUALITY)
    return out.withColumns(
        {"_mix_source": F.col(source_col), "_mix_at": F.log(key) * F.lit(float(BINS_PER_UNIT))}
    ).withColumns(
        {
            "_mix_bin": F.floor("_mix_at"),
            "_mix_sub": F.floor((F.col("_mix_at") - F.floor("_mix_at")) * F.lit(1024.0)),
        }
    )


def source_targets(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP
) -> DataFrame:
    """One row per source: size, target, complete epochs, words left for the
    fractional part. A row per source, so the ordered windows over them are small; how
    these rows meet the documents is left to their size."""
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last())) - 1) % len(weights) + 1),
    )
    by_source = rows.groupBy("_mix_source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    level = Window.orderBy("_ratio", F.col("_mix_source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    here_on = level.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        by_source.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(cap))})
        .withColumns(
            {"_ratio": F.col("_cap") / F.col("_w"), "_all": F.sum("source_size").over(everything) * F.lit(float(share))}
        )
        .withColumn(
            "_level",
            (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(here_on),
        )
        .withColumn(
            "_water",
            F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(everything),
        )
    )
    water = F.col("_water._level")
    target = F.when(F.col("_water").isNull() | (F.col("_ratio") <= water), F.col("_cap")).otherwise(
        water * F.col("_w")
    )
    size = F.col("source_size")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("_target"), size)), F.lit(0)).cast("long")
    return (
        filled.withColumn("_target", target)
        .withColumn("_epochs", epochs)
        .select(
            "_mix_source",
            "source_size",
            F.col("_target").alias("target"),
            "_epochs",
            (F.col("_target") - F.col("_epochs") * size).alias("_rest"),
        )
    )


def _cut(rows: DataFrame, bin_col: str, limits: DataFrame, rest: str, name: str) -> DataFrame:
    """``limits`` with the bin in which ``rest`` ends and what is left for it."""
    ahead = Window.partitionBy("_mix_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.groupBy("_mix_source", F.col(bin_col).alias("_bin"))
        .agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    )
    lim = limits.withColumnRenamed("_mix_source", "_s")
    ends = (
        sums.join(lim.select("_s", rest), F.col("_mix_source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") < F.col(rest)) & (F.col("_before") + F.col("_words") >= F.col(rest)))
        .groupBy("_mix_source")
        .agg(F.min(F.struct("_bin", (F.col(rest) - F.col("_before")).alias("_left"))).alias("_end"))
        .select(F.col("_mix_source").alias("_t"), F.col("_end._bin").alias(f"{name}_bin"), F.col("_end._left").alias(f"{name}_left"))
    )
    return limits.join(ends, F.col("_mix_source").eqNullSafe(F.col("_t")), "left").drop("_t")


def mix_plan(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP
) -> DataFrame:
    """Where every source's fractional part ends: one row per source.

    ``rows`` is what ``sized`` gives; it is read three times, so pass a written
    table of its narrow columns.
    """
    targets = pin(source_targets(rows, weights, share, cap), "mix-targets")
    first = pin(_cut(rows, "_mix_bin", targets, "_rest", "_cut"), "mix-first")
    limits = first.select(F.col("_mix_source").alias("_s"), F.col("_cut_bin"))
    inside = rows.join(
        limits,
        F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_mix_bin") == F.col("_cut_bin")),
    ).drop("_s", "_cut_bin")
    return pin(_cut(inside, "_mix_sub", first, "_cut_left", "_sub"), "mix-plan")


def apply_mix(rows: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (of ``sized``) with source_size, target, copies and taken."""
    p = plan.withColumnRenamed("_mix_source", "_s")
    at = F.col("_mix_bin")
    joined = rows.join(p, F.col("_mix_source").eqNullSafe(F.col("_s")))
    edge = F.coalesce((at == F.col("_cut_bin")) & (F.col("_mix_sub") == F.col("_sub_bin")), F.lit(False))
    ahead = (
        Window.partitionBy("_mix_source").orderBy("_mix_at", F.col(id_col), "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(
        (at < F.col("_cut_bin")) | ((at == F.col("_cut_bin")) & (F.col("_mix_sub") < F.col("_sub_bin"))), F.lit(False)
    )
    clear = joined.where(~edge).withColumn("_in", inside)
    close = (
        joined.where(edge)
        .withColumn("_before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .withColumn("_in", F.col("_before") + F.col("size") / 2 <= F.col("_sub_left"))
        .drop("_before")
    )
    copies = (F.col("_epochs") + F.col("_in").cast("long")).alias("copies")
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in PLACES]
    return clear.unionByName(close).select(
        *keep, "source_size", "target", copies, (copies * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    cap: float = CAP,
    seed: int = SEED,
    with_text: bool = True,
) -> DataFrame:
    """One row per document with size, source_size, target, copies and taken
    (words taken, repeats counted); ``with_text=False`` returns the id only and
    reads the texts once."""
    docs, own, restored = W.aside(docs, *OWN)
    id_col = own(id_col)
    rows = sized(docs, id_col, own(text_col), own(source_col), quality, seed)
    table = pin(rows.select(F.col(id_col), "size", *PLACES), "mix-rows")
    plan = mix_plan(table, weights, share, cap)
    return restored(apply_mix(rows if with_text else table, plan, id_col))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of
    ``docs`` as they were, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    named = [F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))]
    out = mix(docs.select(whole, *named), **options).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.select("_doc", copies).select("_doc.*")
