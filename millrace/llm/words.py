"""Words of whole Arrow text columns as arrays of places and 64-bit hashes.

Texts are UTF-8 bytes; a separator is an ASCII byte, so splitting bytes splits
characters. Hashes stand for words: two different words among a thousand million
share one with a probability of about 3 %.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20  # of text handled at once; a longer text is a slice of its own
BLOCK_BYTES = 1 << 20  # hashed at once; a longer word is a block of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z

#: By byte: is it part of a word? Words between ASCII blanks, and words of ASCII
#: letters, digits and everything outside ASCII.
BLANK_WORD = np.ones(256, bool)
BLANK_WORD[[0x20, *range(0x09, 0x0E)]] = False
PLAIN_WORD = np.zeros(256, bool)
PLAIN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n + 1, base, np.uint64)
        down = np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(BLOCK_BYTES)
_LETTER = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h`` (one to one)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binary values), and where each begins and ends in them; null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def places(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings and ends of the words in lower-cased ``data``, and for every
    text the number of the first of its words (with one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word[data]
    first = np.ones(n, bool)
    np.logical_not(inside[:-1], out=first[1:])
    border = offsets[1:-1]
    first[border[border < n]] = True
    last = np.ones(n, bool)
    np.logical_not(inside[1:], out=last[:-1])
    last[border[border > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + BLOCK_BYTES, "right")))
            block = data[at : ends[j - 1]]
            up, down = (_UP, _DOWN) if len(block) <= BLOCK_BYTES else _powers(len(block))
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_LETTER[block] * up[: len(block)], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
    return mixed(out)


def look_up(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ``table``; -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def order_of(keys: np.ndarray) -> np.ndarray:
    """Stable order of hashes. Their places ride in the low bits, since numpy sorts values several
    times as fast as it finds an order; keys alike in all higher bits are put right afterwards."""
    low = (np.uint64(1) << np.uint64(len(keys).bit_length())) - np.uint64(1)
    ridden = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    ridden.sort()
    order = (ridden & low).astype(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 64:
        return np.argsort(keys, kind="stable")
    for high in ridden[wrong] & ~low:
        begin, end = np.searchsorted(ridden, [high, high | low])
        run = order[begin:end]
        order[begin:end] = run[np.argsort(keys[run], kind="stable")]
    return order


class Places:
    """Places of keys in a sorted table of hashes, as ``look_up`` gives them: hashes are spread
    evenly, so their leading bits say where to begin."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.size, self.shift = len(table), np.uint64(64 - bits)
        self.table = np.append(table, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        found = self.table[at]
        todo = np.flatnonzero(found < keys)
        while len(todo):
            at[todo] += 1
            found[todo] = self.table[at[todo]]
            todo = todo[found[todo] < keys[todo]]
        return np.where((found == keys) & (at < self.size), at, -1)


def bound_batches(spark: SparkSession) -> None:
    """Texts may be long: unless the session chose otherwise, hand Python ``BATCH_ROWS``
    rows at a time, not the default of ten thousand."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


@contextmanager
def number_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started here, which hold no texts, go to Python by Spark's own batches."""
    before = spark.conf.get(BATCH_KEY)
    if before == str(BATCH_ROWS):
        spark.conf.set(BATCH_KEY, "10000")
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, compared as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns an operator uses names of its own for put aside: renamed
    ``docs``, the name a column of the caller has in them, and what gives the names back."""
    used = {n.lower() for n in names}
    new, out = {}, docs
    for c in docs.columns:
        if c.lower() in used:
            new[c] = fresh(out, c)
            out = out.withColumnRenamed(c, new[c])
            while new[c].lower() in used:
                out = out.withColumnRenamed(new[c], longer := fresh(out, new[c] + "_"))
                new[c] = longer

    def restored(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({v: k for k, v in new.items()})

    return out, lambda c: new.get(c, c), restored


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text_col))
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(size):
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], size: Callable[[pa.RecordBatch], pa.Array], least: int
) -> Iterator[pa.RecordBatch]:
    """Rows that come in the order of ``keys`` (never null), in batches of whole groups whose sizes
    add up to ``least`` or more; at the end to what is left."""
    rows, total = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k)
            new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= bool(rows) and values[0] != rows[-1].column(k)[-1]
        before = np.concatenate([[0], np.cumsum(size(batch).to_numpy(zero_copy_only=False))])
        begin = 0
        for i in np.flatnonzero(new).tolist():
            if total + before[i] - before[begin] >= least:
                rows.append(batch.slice(begin, i - begin))
                yield joined()
                rows, total, begin = [], 0, i
        rows.append(batch.slice(begin))
        total += int(before[-1] - before[begin])
    if rows:
        yield joined()


def with_text_columns(
    df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list]]
) -> DataFrame:
    """``df`` with columns computed from its texts, batch by batch. ``make`` gives
    the function, once in a task, from a text array to the values of ``fields``.
    Columns that bear the name of a field are replaced."""
    bound_batches(df.sparkSession)
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text_col):
                values = work(part.column(part.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[v if isinstance(v, pa.Array) else pa.array(v) for v in values]],
                    names=schema.names,
                )

    return df.mapInArrow(run, schema)
