"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

A unit is a word with the blanks before it, or the blanks at the end of a text; a text of n
units is cut after two of its n + 1 unit borders, which a hash of the document id draws. The
bytes of a slice of texts form one wavelet matrix over character classes (is the byte a
continuation byte, is it blank, does it end a unit). Ranks of the classes that end units add up
to the number of borders before a byte, ranks of continuation bytes to the number of code
points; both cuts of all texts are found by one bisection on those ranks.

Defined results: a null text is an empty one, and plain; a null id draws like an empty one;
equal ids draw alike; a text that contains a marker stays plain; texts are cut whole, however
long; an empty table gives an empty table. Results are one struct column, ``fim``; a column of
that name in the input is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  # percent of the texts that are cut
SPM_RATE = 80  # percent of those that have the suffix first

ENDS, BLANK, MORE = 1, 2, 4  # bits of a class: ends a unit, is blank, continues a code point
ENDING = (ENDS, ENDS | BLANK, ENDS | MORE)
CONTINUED = (MORE, MORE | ENDS)

RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class WaveletMatrix:
    """How often a symbol occurs before any place of a sequence, by a bit vector for each bit of
    the symbols; each level holds the symbols with a 0 before those with a 1."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (symbols >> b & 1).astype(bool)
            packed = np.zeros((len(one) >> 6) * 8 + 8, np.uint8)
            packed[: (len(one) + 7) >> 3] = np.packbits(one, bitorder="little")
            packed = packed.view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, len(one) - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        low, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for k, (packed, before, zeros) in enumerate(self.levels):
            ones = [before[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))) for i in (low, at)]
            if symbol >> (len(self.levels) - 1 - k) & 1:
                low, at = zeros + ones[0], zeros + ones[1]
            else:
                low, at = low - ones[0], at - ones[1]
        return at - low

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie end to end."""
    blank = ~W.BLANK_WORD[data]
    last = np.zeros(len(data), bool)
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = True
    follows = np.ones(len(data), bool)
    follows[:-1] = blank[1:]
    follows |= last
    ending = np.where(blank, last, follows)
    more = (data & 0xC0) == 0x80
    return ending.astype(np.uint8) | blank.astype(np.uint8) << 1 | more.astype(np.uint8) << 2


class Cutter:
    """Units and code points of texts that lie end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.matrix = WaveletMatrix(classes(data, offsets), 3)
        self.units_before = self.matrix.ranks(ENDING, offsets)

    def units(self) -> np.ndarray:
        return np.diff(self.units_before)

    def cut(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The first byte after so many units of each of the texts with these numbers."""
        wanted = self.units_before[text] + units
        low, high = self.offsets[text].copy(), self.offsets[text + 1].copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            enough = self.matrix.ranks(ENDING, mid) >= wanted
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        more = self.matrix.ranks(CONTINUED, end) - self.matrix.ranks(CONTINUED, start)
        return end - start - more


def cut_texts(texts: pa.Array, draws: np.ndarray, rate: int, spm_rate: int) -> pa.StructArray:
    """``RESULT`` of each text; ``draws`` holds four numbers for each."""
    data, offsets = W.flat(texts)
    cutter = Cutter(data, offsets)
    n = cutter.units()
    raw = data.tobytes()
    whole = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    marked = np.array([any(m.encode() in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in whole], bool)
    plain = (np.diff(offsets) == 0) | marked | (draws[:, 2] % 100 >= rate)
    spm = ~plain & (draws[:, 3] % 100 < spm_rate)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    chosen = np.flatnonzero(~plain)
    first, second = (cutter.cut(chosen, cuts[chosen, k]) for k in (0, 1))
    prefix = cutter.chars(offsets[chosen], first)
    middle = cutter.chars(first, second)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for i, a, b in zip(chosen.tolist(), first.tolist(), second.tolist()):
        head, mid, tail = raw[offsets[i] : a], raw[a:b], raw[b : offsets[i + 1]]
        whole[i] = b"".join([s, tail, p, head, m, mid] if spm[i] else [p, head, s, tail, m, mid])

    def of_chosen(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(n), np.int64)
        out[chosen] = values
        return pa.array(out, mask=plain)

    form = np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object)
    fields = [pa.array(n, pa.int64()), pa.array(form, pa.string()), of_chosen(prefix), of_chosen(middle), pa.array(whole, pa.string())]
    return pa.StructArray.from_arrays(fields, names=[f.name for f in RESULT.fields])


def draws_of(id_col: str, seed: int) -> Column:
    """Four unsigned 32-bit numbers drawn by a document id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def rearrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """``docs`` with the struct ``fim``: number of units, form (plain, psm, spm), code points of
    prefix and middle (null if plain), and the output text."""
    W.bound_batches(docs.sparkSession)
    docs = docs.drop("fim")
    draws = W.fresh(docs, "draws")
    schema = T.StructType([*docs.schema.fields, T.StructField("fim", RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                drawn = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                found = cut_texts(part.column(part.schema.get_field_index(text_col)), drawn, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=schema.names)

    return docs.withColumn(draws, draws_of(id_col, seed)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is in a text that was cut, and none can
    arise across a border, since ``<`` is the first character of each."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
