"""Lookup of whole columns of tokens in a vocabulary, kept by the Python worker."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TABLES_KEPT = 2
LOOK_UP_BYTES = 2 << 20


def _hashes(tokens: pa.Array) -> np.ndarray:
    return pd.util.hash_array(tokens.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class TokenTable:
    """Names in the order of a 64-bit hash, so that a column of tokens is found by one binary
    search; a hit counts only if its bytes are the same."""

    def __init__(self, names: pa.Array, numbers: pa.Array) -> None:
        h = _hashes(names)
        order = pa.array(np.argsort(h, kind="stable"))
        self.names, self.numbers = names.take(order).cast(pa.large_string()), numbers.take(order)
        self.hashes = h[order.to_numpy()]
        #: Two names with one hash: binary search would miss one of them.
        self.clash = bool((self.hashes[1:] == self.hashes[:-1]).any())

    def find(self, tokens: pa.Array) -> pa.Array:
        """The number of each distinct token, null for those not in the table."""
        tokens = tokens.cast(pa.large_string())
        if self.clash or not len(self.hashes):
            return self.numbers.take(pc.index_in(tokens, value_set=self.names))
        h = _hashes(tokens)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        place = pa.array(at)
        same = pc.and_(pc.equal(self.names.take(place), tokens), pa.array(self.hashes[at] == h))
        return pc.if_else(same, self.numbers.take(place), pa.scalar(None, self.numbers.type))


_tables: OrderedDict[str, TokenTable] = OrderedDict()


def kept_table(key: str, entries: Callable[[], pa.Table]) -> TokenTable:
    """The table under ``key``, built once in a worker from ``entries (token, token_id)``."""
    if key not in _tables:
        names, numbers = (c.combine_chunks() for c in entries().columns)
        _tables[key] = TokenTable(names, numbers)
        while len(_tables) > TABLES_KEPT:
            _tables.popitem(last=False)
    return _tables[key]


def look_up(texts: pa.Array, table: TokenTable) -> pa.Array:
    """Lists of numbers for texts of blank-separated tokens, null for tokens that are not in
    the table. Texts are split ``LOOK_UP_BYTES`` at a time, since tokens take many times the bytes
    of their texts; a distinct token is looked up once each time."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    slices = np.cumsum(lengths, dtype=np.int64) // LOOK_UP_BYTES
    starts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist()]
    ends = [*starts[1:], len(texts)]
    return pa.concat_arrays([_look_up(texts.slice(a, b - a), table) for a, b in zip(starts, ends, strict=True)])


def _look_up(texts: pa.Array, table: TokenTable) -> pa.Array:
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = parts.flatten().dictionary_encode()
    number = table.find(coded.dictionary)
    real = pc.not_equal(coded.dictionary, "").take(coded.indices)
    found = number.take(coded.indices).filter(real)
    # Tokens before each text, without the empty ones.
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), found.cast(pa.int32()))


def filled(ids: pa.Array, missing: pa.Array) -> pa.Array:
    """``ids`` with its nulls, in order, replaced by the values of the lists ``missing``."""
    values = pc.list_flatten(ids)
    values = pc.replace_with_mask(values, pc.is_null(values), pc.list_flatten(missing).cast(values.type))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
