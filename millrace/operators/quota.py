"""Quotas, ids and the union of several sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cleaning import clean_and_keep
from millrace.operators.ranking import index_from_place, write_in_order
from millrace.session import pin, spread

Save = Callable[[DataFrame, str], DataFrame]

SKETCH_KEYS = 10_000
SLICE_BITS = 57  # a row's number has its slice above them


@dataclass(frozen=True)
class Source:
    """A table of raw texts with a unique sort key and its cleaning rule."""

    domain: str
    rows: DataFrame
    order: Sequence[str]
    cleaner: Callable[[Column], Column]
    text: str = "text"


class Kept(NamedTuple):
    """What a source keeps: its ``texts (_row, text)``, written once and never moved for their
    order, and their ``places (order..., _row, _slice, _place)``."""

    texts: DataFrame
    places: DataFrame


def _slice_bounds(rows: DataFrame, order: Sequence[str], quota: int, total: int) -> list[tuple | None]:
    """Upper key bounds of slices that double in size; the last is open.

    Quantiles come from a mergeable sketch, the ``SKETCH_KEYS`` keys of least hash, so keys
    may be of any type that can be sorted, and of several columns. They only say how much
    a slice holds; whatever they are, slices are value ranges.
    """
    shares, share = [], 1.5 * quota / total
    while share < 1.0:
        shares.append(share)
        share *= 2
    if not shares:
        return [None]
    sketch = rows.orderBy(F.xxhash64(*order)).limit(SKETCH_KEYS).orderBy(*order).collect()
    cuts = [tuple(sketch[int(share * len(sketch))]) for share in shares]
    return [*dict.fromkeys(cuts), None]


def _between(rows: DataFrame, order: Sequence[str], low: tuple | None, high: tuple | None) -> Column:
    """Is the key above ``low`` and not above ``high``? Keys are compared as structs, in which
    nulls are least; the first column is compared by itself too, for the scan to skip by."""
    key = F.struct(*order)

    def bound(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, values)])

    first, inside = F.col(order[0]), F.lit(True)
    if low is not None:
        inside &= key > bound(low)
        if low[0] is not None:
            inside &= first >= F.lit(low[0])
    if high is not None:
        inside &= key <= bound(high)
        if high[0] is not None:
            inside &= (first <= F.lit(high[0])) | first.isNull()
    return inside


def first_kept(
    source: Source, quota: int | None, min_words_exclusive: int = 10, save: Save = pin
) -> Kept:
    """Cleaned rows of ``source`` that pass the length filter, and their places in source
    order. A quota of 0 takes no rows.

    Cleaning and filtering run in the scan, once, and what is kept is written; only the
    keys are then put in order, each with the number of its row.

    Without a quota below the table size this is one pass. With one, the table
    is cleaned in slices along the sort key, each twice the last, until enough
    rows are kept: a small quota on a huge source reads a small part of it. The
    slices are value ranges, so the kept rows are always a whole prefix of the
    source order and contain its first ``quota`` kept rows.
    """
    order = list(source.order)
    rows = source.rows.select(*order, F.col(source.text).alias("text"))

    def kept_in(part: DataFrame, number: int) -> Kept:
        kept = clean_and_keep(spread(part, *order), source.cleaner, min_words_exclusive)
        row = F.monotonically_increasing_id() + F.lit(number << SLICE_BITS)
        texts = save(kept.withColumn("_row", row), f"kept-{source.domain}-{number}")
        keys = texts.select(*order, "_row").withColumn("_slice", F.lit(number))
        places = write_in_order(keys, order, label=f"order-{source.domain}-{number}", save=save)
        return Kept(texts.select("_row", "text"), places)

    if quota is not None and quota <= 0:
        return kept_in(rows.limit(0), 0)
    total = 0 if quota is None else rows.count()
    if quota is None or quota >= total:
        return kept_in(rows, 0)
    parts, found, low = [], 0, None
    for number, high in enumerate(_slice_bounds(rows.select(*order), order, quota, total)):
        parts.append(kept_in(rows.filter(_between(rows, order, low, high)), number))
        found += parts[-1].places.count()
        low = high
        if found >= quota:
            break
    return Kept(*(reduce(DataFrame.unionByName, tables) for tables in zip(*parts)))


class Numbered(NamedTuple):
    """``index (id, domain, pos, _row)``, narrow, and ``texts (domain, _row, text)``."""

    index: DataFrame
    texts: DataFrame

    def join(self) -> DataFrame:
        """``(id, domain, text, pos)``: each text is fetched by its row's number, when read."""
        return self.texts.join(self.index, ["domain", "_row"]).select("id", "domain", "text", "pos")


def number_sources(
    sources: Sequence[Source],
    quotas: Sequence[int | None],
    min_words_exclusive: int = 10,
    save: Save = pin,
) -> Numbered:
    """Ids and positions of all sources, one after the other, apart from the texts; ids count
    from 0 within a source."""
    with ThreadPoolExecutor(len(sources)) as pool:
        # Sources are independent; their jobs share the cluster.
        kept_tables = list(
            pool.map(lambda s, q: first_kept(s, q, min_words_exclusive, save), sources, quotas)
        )
    indexes, texts, offset = [], [], 0
    for source, quota, kept in zip(sources, quotas, kept_tables, strict=True):
        indexed = index_from_place(kept.places, slices="_slice")
        if quota is not None:
            indexed = indexed.filter(F.col("idx") < quota)
        indexes.append(
            indexed.select(
                F.concat(F.lit(f"{source.domain}_"), F.col("idx").cast("string")).alias("id"),
                F.lit(source.domain).alias("domain"),
                (F.col("idx") + F.lit(offset)).cast("bigint").alias("pos"),
                "_row",
            )
        )
        texts.append(kept.texts.select(F.lit(source.domain).alias("domain"), "_row", "text"))
        # Counting a written table reads its footers only.
        found = kept.places.count()
        offset += found if quota is None else min(quota, found)
    return Numbered(reduce(DataFrame.unionByName, indexes), reduce(DataFrame.unionByName, texts))


def union_sources(
    sources: Sequence[Source],
    quotas: Sequence[int | None],
    min_words_exclusive: int = 10,
    save: Save = pin,
) -> DataFrame:
    """``(id, domain, text, pos)`` of all sources, one after the other; ids
    count from 0 within a source."""
    return number_sources(sources, quotas, min_words_exclusive, save).join()
