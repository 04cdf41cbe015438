"""Exact global ranks and running totals without a single-task sort.

Two ways, both independent of the physical partitioning:

* ``rank_in_bins`` for keys that fall evenly into bins by themselves (a hash
  order, a dense integer). Rows are counted per bin, bins are prefix-summed,
  and each bin is ranked on its own: one exchange of the rows, keyed by bin.
* ``write_in_order`` and ``index_from_place`` for any unique sort key, however
  skewed: rows are range-partitioned, sorted and written with their place, and
  the place becomes a rank by adding one offset per partition. ``dense_index``
  does this to the key columns alone and joins the rows to their index.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.joining import join_null_safe
from millrace.session import pin

HEX_DIGITS = 4
MAX_BINS = 16**HEX_DIGITS
MIN_BIN = 1024


def rank_in_bins(
    df: DataFrame,
    bin_of: Column,
    order: Sequence[Column],
    by: Sequence[str] = (),
    totals: Mapping[str, Column | None] = MappingProxyType({"pos": None}),
) -> DataFrame:
    """Add one column per entry of ``totals``: the weight of all rows before
    this one, or their number where the weight is None.

    ``bin_of`` must be monotone in ``order``, and ``order`` unique within
    ``by``. Window and join share one key, a struct of group and bin, so the
    rows are exchanged and sorted once; in a struct, nulls equal each other.
    The only unsplit step is the prefix sum over the bin counts of a group.
    """
    weights = {
        name: F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
        for name, weight in totals.items()
    }
    measured = df.withColumn("_key", F.struct(*by, bin_of.alias("_bin"))).withColumns(
        {f"_w_{name}": weight for name, weight in weights.items()}
    )

    def before(window: WindowSpec, name: str) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(f"_w_{name}").over(earlier), F.lit(0))

    groups = Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy(F.col("_key")["_bin"])
    starts = (
        measured.groupBy("_key")
        .agg(*[F.sum(f"_w_{name}").alias(f"_w_{name}") for name in weights])
        .select(
            F.col("_key").alias("_bin_key"),
            *[before(groups, name).alias(f"_start_{name}") for name in weights],
        )
    )
    in_bin = Window.partitionBy("_key").orderBy(*order)
    inside = measured.withColumns({f"_in_{name}": before(in_bin, name) for name in weights})
    added = {name: F.col(f"_start_{name}") + F.col(f"_in_{name}") for name in weights}
    helpers = [f"_{kind}_{name}" for name in weights for kind in ("w", "in", "start")]
    return (
        inside.join(starts, F.col("_key") == F.col("_bin_key"))
        .withColumns(added)
        .drop("_key", "_bin_key", *helpers)
    )


def rank_by_hash(
    df: DataFrame,
    digest: Column,
    tie: Sequence[str],
    by: Sequence[str] = (),
    totals: Mapping[str, Column | None] = MappingProxyType({"pos": None}),
    hex_digits: int = HEX_DIGITS,
) -> DataFrame:
    """Rank by a hex digest. Its leading digits make 16**hex_digits even bins,
    so a group holding most of the rows is split like any other."""
    hashed = df.withColumn("_digest", digest)
    bins = F.substring("_digest", 1, hex_digits)
    order = [F.col("_digest"), *map(F.col, tie)]
    return rank_in_bins(hashed, bins, order, by, totals).drop("_digest")


def running_total(
    df: DataFrame,
    pos: str,
    weight: Column,
    by: Sequence[str] = (),
    name: str = "start",
    bin_size: int | None = None,
) -> DataFrame:
    """Add the weight of all earlier rows, for a dense 0-based ``pos``, whose
    value range cut into equal pieces makes even bins.

    Without ``bin_size`` the rows are counted (a footer read on a written
    table) to get at most ``MAX_BINS`` bins of at least ``MIN_BIN`` rows.
    """
    size = bin_size or max(MIN_BIN, -(-df.count() // MAX_BINS))
    return rank_in_bins(df, F.expr(f"`{pos}` div {size}"), [F.col(pos)], by, {name: weight})


def write_in_order(
    df: DataFrame,
    order: Sequence[str],
    then: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    label: str = "ordered",
    save: Callable[[DataFrame, str], DataFrame] = pin,
) -> DataFrame:
    """Range-partition and sort ``df``, apply the row-wise step ``then``, and
    ``save`` the rows with ``_place``: partition number in the high bits, row
    number within the partition in the low 33. Once written, every reader sees
    the same places."""
    rows = then(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return save(rows.withColumn("_place", F.monotonically_increasing_id()), label)


def index_from_place(
    placed: DataFrame,
    by: Sequence[str] = (),
    name: str = "idx",
    slices: str | None = None,
    save: Callable[[DataFrame, str], DataFrame] = pin,
) -> DataFrame:
    """Replace ``_place`` by the 0-based rank of the row (within ``by``).

    Rows of a group are contiguous in every partition, so a partition needs one
    count and one first place per group. Without ``by`` these are counted at once, a row
    per partition, and go to all readers with the plan; with ``by`` they may be many, so
    they are written down and their size decides how they are joined.
    ``slices`` names a column that orders several written tables.
    """
    part = ([slices] if slices else []) + ["_part"]
    rows = placed.withColumn("_part", F.shiftright("_place", 33))
    before = Window.partitionBy(*by).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by, *part)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if by:
        starts = save(starts, "offsets")
    else:
        counted = placed.sparkSession.createDataFrame(starts.collect(), starts.schema)
        starts = F.broadcast(counted)
    index = F.col("_start") + F.col("_place") - F.col("_first")
    return (
        join_null_safe(rows, starts, [*by, *part])
        .withColumn(name, index.cast("bigint"))
        .drop("_place", "_start", "_first", *part)
    )


def dense_index(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "idx",
    first: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row in ``order`` (within ``by``); with
    ``first``, keep that many rows per group only.

    Ties in ``order`` are broken arbitrarily, and each row gets one index. The rows are
    written with a number of their own; only keys and numbers are put in order, and meet
    their rows again by the number.
    """
    keys = [*by, *order]
    numbered = pin(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ranked = index_from_place(write_in_order(numbered.select(*keys, "_row"), [*keys, "_row"]), by, name)
    if first is not None:
        ranked = ranked.filter(F.col(name) < first)
    return numbered.join(ranked.select("_row", name), "_row").drop("_row")
