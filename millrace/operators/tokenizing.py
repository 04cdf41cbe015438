"""Texts to token ids to overlapping fixed-length fragments.

Three vocabularies: a stateless hash (pure expression), one counted from the
corpus, and any tokenizer object the caller brings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.token_table import filled, kept_table, look_up
from millrace.functions.tokens import (
    attention_mask,
    hash_token_ids,
    pad_right,
    token_windows,
    words,
)
from millrace.operators.joining import BROADCAST_ROWS
from millrace.operators.ranking import index_from_place, write_in_order
from millrace.session import pin

MAX_LOOKUP_ENTRIES = 1_000_000
SALTS = 32


class Tokenizer(Protocol):
    """What a caller's tokenizer has to offer."""

    def encode(self, texts: list[str]) -> list[list[int]]: ...


def vocabulary(df: DataFrame, size: int, text: str = "text", first_id: int = 0) -> DataFrame:
    """``(token, n, token_id)``: the ``size`` most frequent tokens, ties by
    token, numbered from ``first_id``.

    The counted tokens are range-partitioned by frequency and written, and their
    place becomes their number: no step sees them all in one task.
    """
    counts = (
        df.select(F.explode(words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg((-F.count(F.lit(1))).alias("_rarity"))
    )
    ranked = index_from_place(write_in_order(pin(counts, "token-counts"), ["_rarity", "token"], label="tokens"))
    return ranked.filter(F.col("idx") < size).select(
        "token", (-F.col("_rarity")).alias("n"), (F.col("idx") + first_id).cast("int").alias("token_id")
    )


def encode_hash(df: DataFrame, vocab_size: int, text: str = "text", name: str = "ids") -> DataFrame:
    return df.withColumn(name, hash_token_ids(F.col(text), vocab_size))


def encode_vocab(
    df: DataFrame,
    vocab: DataFrame,
    unk_id: int,
    text: str = "text",
    name: str = "ids",
    max_lookup: int = MAX_LOOKUP_ENTRIES,
) -> DataFrame:
    """Token ids under ``vocab``; tokens outside it get ``unk_id``, a null text has
    none.

    The ``max_lookup`` entries of least id, the most frequent ones, are handed to the workers,
    which keep them as a table and look up whole columns of tokens, while the texts stay where
    they are. Entries beyond those, if there are any, meet in a join the tokens that
    were not found: few, where ids go by frequency, and salted, where they do not.
    """
    entries = vocab.select("token", F.col("token_id").cast("int"))
    head = entries.orderBy("token_id").limit(max_lookup + 1).toArrow()
    more = head.num_rows > max_lookup
    shared = df.sparkSession.sparkContext.broadcast(head.slice(0, max_lookup))
    key = uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return look_up(texts, kept_table(key, lambda: shared.value))

    found = ids(F.col(text))
    if not more:
        return df.withColumn(name, found).withColumn(name, F.transform(name, lambda i: F.coalesce(i, F.lit(unk_id))))
    last = head.column(1)[max_lookup - 1].as_py() if max_lookup else None
    tail = entries if last is None else entries.where(F.col("token_id") > last)
    return _with_tail(df.withColumn(name, found), tail, unk_id, text, name)


def _with_tail(df: DataFrame, tail: DataFrame, unk_id: int, text: str, name: str) -> DataFrame:
    """``df`` with the nulls among its ids replaced by what ``tail`` says of their tokens."""
    rows = pin(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    open_ = rows.where(F.exists(name, lambda i: i.isNull())).select(
        "_row", F.posexplode(F.arrays_zip(words(F.col(text)).alias("token"), F.col(name).alias("id"))).alias("_pos", "_t")
    )
    tokens = open_.where("_t.id IS NULL").select("_row", "_pos", "_t.token", (F.col("_pos") % SALTS).alias("_salt"))
    salted = tail.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = tokens.join(salted.hint("merge"), ["token", "_salt"], "left").select(
        "_row", F.struct("_pos", F.coalesce("token_id", F.lit(unk_id)).alias("_id")).alias("_t")
    )
    missing = found.groupBy("_row").agg(
        F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["_id"]).alias("_missing")
    )

    @F.arrow_udf("array<int>")
    def whole(ids: pa.Array, lists: pa.Array) -> pa.Array:
        return filled(ids, lists)

    empty = F.array().cast("array<int>")
    joined = rows.join(missing, "_row", "left").withColumn("_missing", F.coalesce("_missing", empty))
    return joined.withColumn(name, whole(F.col(name), F.col("_missing"))).drop("_row", "_missing")


def encode_by_join(
    df: DataFrame,
    vocab: DataFrame,
    unk_id: int,
    text: str = "text",
    name: str = "ids",
    salts: int = SALTS,
    small: int = BROADCAST_ROWS,
) -> DataFrame:
    """``encode_vocab`` for a vocabulary of any size.

    A vocabulary of up to ``small`` entries is broadcast to the tokens. With a larger one,
    tokens meet their ids in a join salted by position, which spreads a
    frequent token over ``salts`` tasks. The arrays are rebuilt per row, partly
    before the exchange. The rows are written first, with a number of their own,
    so no column has to be unique.
    """
    entries = pin(vocab.select("token", "token_id"), "vocabulary")
    rows = pin(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    tokens = rows.select("_row", F.posexplode(words(F.col(text))).alias("_pos", "token"))
    if entries.count() <= small:
        met = tokens.join(F.broadcast(entries), "token", "left")
    else:
        salted = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = tokens.withColumn("_salt", F.col("_pos") % salts).join(salted.hint("merge"), ["token", "_salt"], "left")
    found = met.select(
        "_row", F.struct("_pos", F.coalesce("token_id", F.lit(unk_id)).alias("_id")).alias("_t")
    )
    arrays = found.groupBy("_row").agg(
        F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["_id"]).alias(name)
    )
    empty = F.array().cast("array<int>")
    return (
        rows.drop(name).join(arrays, "_row", "left").withColumn(name, F.coalesce(name, empty)).drop("_row")
    )


def encode_with(
    df: DataFrame,
    make_tokenizer: Callable[[], Tokenizer],
    text: str = "text",
    name: str = "ids",
) -> DataFrame:
    """Token ids from a caller's tokenizer, built once per Python worker and
    fed whole Arrow batches."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for texts in batches:
            yield pd.Series(tokenizer.encode(texts.fillna("").tolist()), dtype=object)

    return df.withColumn(name, ids(F.col(text)))


def fragments(
    df: DataFrame,
    length: int,
    stride: int,
    pad_id: int,
    ids: str = "ids",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per window: ``original_id, domain, fragment_idx, input_ids,
    attention_mask`` plus the columns in ``keep``.

    Only the columns named here are copied into the fragments, so the text of
    a document is not repeated.
    """
    windows = df.select(
        F.col("id").alias("original_id"),
        "domain",
        *keep,
        F.posexplode(token_windows(F.col(ids), length, stride)).alias("fragment_idx", "_window"),
    )
    return windows.select(
        "original_id",
        "domain",
        *keep,
        "fragment_idx",
        pad_right(F.col("_window"), length, pad_id).alias("input_ids"),
        attention_mask(F.col("_window"), length).alias("attention_mask"),
    )
