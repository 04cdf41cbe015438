"""Removal of long repeated passages: suffix arrays over the texts around shared anchors.

Every byte goes that is covered by a string of ``window`` bytes which starts at two places or
more, in one text or several; strings overlap, and are judged on the input.

1. *Anchors.* In each window the least hash of its ``gram``-byte strings marks an anchor, the
   leftmost of equals. It depends on the window alone, so equal windows have equal anchors, and
   each window belongs to one. The windows of an anchor are consecutive; with their bytes they
   are its context. Only a hash of the anchor and one of the context travel, with their place.
2. *Equal contexts* stand side by side in the order of the two hashes: all their windows repeat.
   Of an anchor with several contexts, one occurrence of each context is looked at further.
3. *Suffix arrays.* Those contexts meet by anchor in shards of bounded size. A shard sorts its
   suffixes by Larsson-Sadakane refinement; Kasai's common prefixes with the neighbours in that
   order tell which windows repeat.
4. *Merging.* An anchor with over ``hot`` contexts is dealt to several shards. Each sends its
   distinct windows of that anchor in the order of a 128-bit digest, cut at the borders of as
   many ranges by binary search; a range merges the sorted runs by binary search again.

Contexts are compared by two 64-bit hashes, windows within a shard byte by byte, those across
shards by digests. Texts are taken as a set of distinct texts with equal results, under their
MD5.

Defined results: a null text is an empty one; ids are not looked at, so null and repeated ids
are rows like any other; equal texts of ``window`` bytes or more repeat each other and go whole;
shorter texts stay; an empty table gives an empty table. Results are one struct column, ``cut``;
a column of that name in the input is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.session import pin

WINDOW = 200
GRAM = 64
HOT = 2048  # contexts of one anchor in one shard
SHARD_BYTES = 1 << 20
BLOCK = 1 << 18  # window starts handled at once
PLACE_BITS = 24  # of a place within a block
SEEN = 1 << 16  # texts a task remembers, to see copies before they travel

_RNG = np.random.default_rng(13)
_LETTER = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BYTE = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType())}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


ANCHOR = _schema(h="long", d="long", key="binary", start="int", n="int", more="ints")
FOUND = _schema(key="binary", start="int", n="int", h="long", many="boolean")
CONTEXT = _schema(h="long", m="int", salt="int", key="binary", start="int", many="boolean", bytes="binary")
SHARD = _schema(key="binary", start="int", n="int", h="long", part="int", a="binary", b="binary", keys="binary", starts="binary")
MARK = _schema(key="binary", start="int", n="int")
CUT = _schema(kept="binary", n_bytes="long", n_removed="long", n_spans="long")


def gram_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hash of the string of each size at each place, by doubling; undefined where it would pass the end."""
    h, width, out = _LETTER[data], 1, {}
    with np.errstate(over="ignore"):
        for size in sorted(sizes):
            while 2 * width <= size:
                h, width = _paired(h, width), 2 * width
            out[size] = h if size == width else _paired(h, size - width)
    return [out[s] for s in sizes]


def _paired(h: np.ndarray, shift: int) -> np.ndarray:
    out = h * _TIMES
    out[:-shift] += h[shift:]
    out ^= out >> np.uint64(29)
    return out


def _power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def _runs(first: np.ndarray, total: int) -> np.ndarray:
    """Lengths of runs that begin at the places ``first``."""
    return np.diff(np.append(first, total))


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """``(text, start, n, h, d)`` of the anchors of texts that lie end to end: the windows from
    ``start`` on, ``n`` of them, have the anchor with hash ``h``; ``d`` is their context's hash."""
    span, big = window - gram + 1, _power_below(window)
    usable = np.maximum(np.diff(offsets) - window + 1, 0)
    valid = np.zeros(len(data) + 1, np.int32)  # becomes 1 where a window starts
    np.add.at(valid, offsets[:-1], usable > 0)
    np.add.at(valid, (offsets[:-1] + usable), -(usable > 0).astype(np.int32))
    valid = np.cumsum(valid[:-1]) > 0
    out = []
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data), BLOCK):
        ok = np.flatnonzero(valid[at : at + BLOCK])
        if not len(ok):
            continue
        block = data[at : at + BLOCK + window - 1]
        small, large = gram_hashes(block, gram, big)
        least, width = (small & ~mask) | np.arange(len(block), dtype=np.uint64), 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            rest = span - width
            least = np.minimum(least[:-rest], least[rest:])
        place = (least[ok] & mask).astype(np.int64)
        new = np.ones(len(ok), bool)
        # Windows of two texts cannot share an anchor, since none lies in both.
        new[1:] = place[1:] != place[:-1]
        first = np.flatnonzero(new)
        n = _runs(first, len(ok))
        s = ok[first]
        last = s + n + window - 1 - big
        d = n.astype(np.uint64)
        for probe in (s, np.minimum(s + big, last), np.minimum(s + 2 * big, last), last):
            d = W.combined(d, large[probe])
        out.append((s + at, n, W.mixed(small[place[first]]), d))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    start, n, h, d = (np.concatenate(x) for x in zip(*out))
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], n, h, d


def _anchor_rows(keys: pa.Array, texts: pa.Array, window: int, gram: int, seen: dict[bytes, bool]) -> pa.RecordBatch:
    """``ANCHOR`` rows of a slice; occurrences of one context in one text are one row, and a text
    this task has seen before is one row, which says that all of it repeats."""
    names, fresh, again = keys.to_pylist(), [], []
    for i, key in enumerate(names):
        if key not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen[key] = False
            fresh.append(i)
        elif not seen[key]:
            seen[key] = True
            again.append(i)
    data, offsets = W.flat(texts.take(pa.array(fresh, pa.int64())))
    text, start, n, h, d = anchors(data, offsets, window, gram)
    order = np.lexsort((start, d, h, text))
    text, start, n, h, d = (x[order] for x in (text, start, n, h, d))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    others = pa.array(start[~new], pa.int32())
    sizes = _runs(first, len(text)) - 1
    sizes = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    more = pa.ListArray.from_arrays(sizes, others)
    more = pc.if_else(pc.equal(pc.list_value_length(more), 0), pa.scalar(None, more.type), more)
    columns = [
        pa.array(h[first].view(np.int64)),
        pa.array(d[first].view(np.int64)),
        pa.array([names[fresh[i]] for i in text[first].tolist()], pa.binary()),
        pa.array(start[first], pa.int32()),
        pa.array(n[first], pa.int32()),
        more,
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=ANCHOR.names)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    rows = [
        {"h": int.from_bytes(names[i][:8], "big", signed=True), "d": 0, "key": names[i], "start": 0, "n": lengths[i] - window + 1, "more": [0]}
        for i in again
        if lengths[i] >= window
    ]
    if rows:
        extra = pa.RecordBatch.from_pylist(rows, schema=batch.schema)
        batch = pa.Table.from_batches([batch, extra]).combine_chunks().to_batches()[0]
    return batch


def find_anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``ANCHOR`` rows of ``texts (key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield _anchor_rows(part.column(0), part.column(1), window, gram, seen)

    return texts.mapInArrow(run, ANCHOR)


def _words_of(keys: pa.Array) -> np.ndarray:
    """16-byte keys as rows of two numbers."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)


def judge(rows: DataFrame) -> DataFrame:
    """Of ``ANCHOR`` rows ``FOUND`` rows: windows that repeat (``h`` is null), and one occurrence
    of each context of an anchor that has several (``many``: it repeats as a whole).

    One pass over rows in order, whatever an anchor's number of rows; a row is judged when its
    successor is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        before = None  # h, d, key, start of the row before, and h of the row before its context
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            out, before = _judged(batch, before, False)
            held = batch.slice(batch.num_rows - 1)
            yield out
        if held is not None:
            yield _judged(held, before, True)[0]

    ordered = rows.repartition("h").sortWithinPartitions("h", "d", "key", "start")
    return ordered.mapInArrow(run, FOUND)


def _judged(batch: pa.RecordBatch, before: tuple | None, last: bool) -> tuple[pa.RecordBatch, tuple | None]:
    """Verdicts on all rows but the last one (``last``: on that too)."""
    h, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    key = _words_of(batch.column(2))
    start = batch.column(3).to_numpy(zero_copy_only=False)
    rows = len(h)
    same_h, same = np.zeros(rows + 1, bool), np.zeros(rows + 1, bool)  # as the row before
    twin = np.zeros(rows, bool)
    same_h[1:rows] = h[1:] == h[:-1]
    same[1:rows] = same_h[1:rows] & (d[1:] == d[:-1])
    twin[1:] = same[1:rows] & (key[1:] == key[:-1]).all(axis=1) & (start[1:] == start[:-1])
    if before is not None:
        same_h[0] = h[0] == before[0]
        same[0] = same_h[0] and d[0] == before[1]
        twin[0] = same[0] and bytes(key[0]) == before[2] and start[0] == before[3]
    # Does the row before this row's context have the same anchor?
    begins = np.maximum.accumulate(np.where(same[:rows], -1, np.arange(rows)))
    earlier = np.where(begins >= 0, same_h[np.maximum(begins, 0)], bool(before and before[4]))
    more = batch.column(5)
    again = pc.is_valid(more).to_numpy(zero_copy_only=False)
    many = same[:rows] | same[1:] | again
    judged = np.ones(rows, bool)
    judged[rows - 1] = last
    marked = np.flatnonzero(judged & many & ~twin)
    inner = pc.list_flatten(more.take(pa.array(marked)))
    owner = marked[pc.list_parent_indices(more.take(pa.array(marked))).to_numpy(zero_copy_only=False)]
    shown = np.flatnonzero(judged & ~same[1:] & (earlier | same_h[1:]))
    which = pa.array(np.concatenate([marked, owner, shown]), pa.int64())
    quiet = np.zeros(len(which), bool)
    quiet[: len(marked) + len(owner)] = True
    columns = [
        batch.column(2).take(which),
        pa.concat_arrays([batch.column(3).take(pa.array(marked)), inner.cast(pa.int32()), batch.column(3).take(pa.array(shown))]),
        batch.column(4).take(which),
        pa.array(h[which.to_numpy()], pa.int64(), mask=quiet),
        pa.array(many[which.to_numpy()]),
    ]
    out = pa.RecordBatch.from_arrays(columns, names=FOUND.names)
    # The last row is judged with the next batch, so what is before it is the row before.
    if rows > 1:
        before = (h[-2], d[-2], bytes(key[-2]), start[-2], bool(earlier[-2]))
    return out, before


def contexts(texts: DataFrame, shown: DataFrame, window: int, hot: int) -> DataFrame:
    """``CONTEXT`` rows of the ``FOUND`` rows to look at; anchors with over ``hot`` of them are dealt
    to ``m`` shards."""
    large = shown.groupBy("h").agg(F.ceil(F.count("*") / hot).cast("int").alias("m")).where("m > 1")
    dealt = shown.join(pin(large, "hot-anchors"), "h", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    place = F.struct("start", "n", "h", "many", "m", F.pmod(F.xxhash64("key", "start"), F.col("m")).cast("int").alias("salt"))
    wanted = dealt.groupBy("key").agg(F.collect_list(place).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in W.slices(batch, "text"):
                keys, texts, wanted = part.columns
                names = keys.to_pylist()
                new = [k != b for k, b in zip(names, [before, *names[:-1]])]  # copies come one after another
                before = names[-1] if names else before
                for i in np.flatnonzero(new).tolist():
                    data = texts[i].as_buffer().to_pybytes()
                    rows = pa.RecordBatch.from_struct_array(wanted[i].values)
                    starts, ns = rows.column("start").to_pylist(), rows.column("n").to_pylist()
                    cut = [data[s : s + n + window - 1] for s, n in zip(starts, ns)]
                    owner = pa.array([names[i]] * len(cut), pa.binary())
                    columns = [rows.column("h"), rows.column("m"), rows.column("salt"), owner, rows.column("start"), rows.column("many"), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=CONTEXT.names)

    return texts.join(wanted, "key").select("key", "text", "wanted").mapInArrow(run, CONTEXT)


def _big_endian(data: np.ndarray, pad: int = 8) -> np.ndarray:
    """The eight bytes at each place as one number."""
    padded = np.concatenate([data, np.zeros(pad, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Order of all suffixes of texts that lie end to end, each ended by a mark of its own that
    is less than any byte, earlier texts' marks being less. Larsson and Sadakane's refinement:
    groups of suffixes alike so far are sorted by the ranks of what follows, with doubled length
    in each round; those alone in their group are left."""
    n, texts = len(data), len(cuts) - 1
    text = np.repeat(np.arange(texts), np.diff(cuts))
    left = cuts[1:][text] - np.arange(n)
    depth = 7
    seven = _big_endian(data) >> np.uint64(8)
    short = np.flatnonzero(left < depth)
    seven[short] &= ~np.uint64(0) << ((depth - left[short]).astype(np.uint64) * np.uint64(8))
    first = seven << np.uint64(8) | np.minimum(left, depth).astype(np.uint64)
    order = np.argsort(first)
    rank = np.empty(n, np.int64)
    open_ = np.arange(n)
    key = first[order]
    scale = n + texts
    while True:
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        sizes = _runs(heads, len(open_))
        rank[order[open_]] = np.repeat(open_[heads], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        if not len(open_):
            return order
        at = order[open_]
        follows = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)] + texts, text[at])
        key = rank[at] * scale + follows
        by = np.argsort(key)
        order[open_] = at[by]
        key = key[by]
        depth *= 2


def common_prefixes(data: np.ndarray, cuts: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of the first ``starts`` places of each text, the length of the prefix that its
    suffix shares with the suffix before it in ``order``; 0 for other places. Kasai's walk: the
    length falls by one at most from place to place. All texts are walked side by side."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    end = np.repeat(cuts[1:], np.diff(cuts))
    eight = np.concatenate([_big_endian(data), np.zeros(1, np.uint64)])
    out = np.zeros(n, np.int64)
    lanes = np.argsort(-starts, kind="stable")
    base, count = cuts[:-1][lanes], starts[lanes]
    length = np.zeros(len(lanes), np.int64)
    for step in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -step, "left"))
        i = base[:live] + step
        j = before[i]
        length = np.maximum(length[:live] - 1, 0)
        limit = np.where(j >= 0, np.minimum(end[i] - i, end[j] - j), 0)
        length = np.minimum(length, limit)
        walk = np.flatnonzero(length < limit)
        while len(walk):
            x = eight[i[walk] + length[walk]] ^ eight[j[walk] + length[walk]]
            length[walk] = np.minimum(length[walk] + np.where(x == 0, 8, 7 - np.searchsorted(_BYTE, x, "right")), limit[walk])
            walk = walk[(x == 0) & (length[walk] < limit[walk])]
        out[i] = length
    return out


def _digests(data: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    big = _power_below(window)
    (large,) = gram_hashes(data, big)
    x, y = large[places], large[places + window - big]
    with np.errstate(over="ignore"):
        return tuple(W.mixed(W.mixed(x * seed) + y) for seed in _SEEDS)


def _shard(rows: pa.RecordBatch, window: int) -> list[pa.RecordBatch]:
    """``SHARD`` rows: windows that repeat within a shard, and runs of the distinct windows of
    anchors that are dealt to several shards."""
    data, cuts = W.flat(rows.column(6))
    sizes = np.diff(cuts)
    starts = sizes - window + 1
    order = suffix_array(data, cuts)
    common = common_prefixes(data, cuts, order, starts)
    like = np.append(common[order] >= window, False)  # as the suffix before
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data)) - cuts[:-1][text]
    repeats = np.empty(len(data), bool)
    repeats[order] = like[:-1] | like[1:]
    many = rows.column(5).to_numpy(zero_copy_only=False)
    base = rows.column(4).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(repeats & ~many[text])
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(text[hit]) != 0)
    first = np.flatnonzero(new)
    owner = text[hit[first]]
    none = pa.nulls(len(first))
    marks = [
        rows.column(3).take(pa.array(owner)),
        pa.array(base[owner] + place[hit[first]], pa.int32()),
        pa.array(_runs(first, len(hit)), pa.int32()),
        none.cast(pa.int64()),
        none.cast(pa.int32()),
        *[none.cast(pa.binary())] * 4,
    ]
    out = [pa.RecordBatch.from_arrays(marks, names=SHARD.names)]
    m = rows.column(1).to_numpy(zero_copy_only=False)
    if not (m > 1).any():
        return out
    h = rows.column(0).to_numpy(zero_copy_only=False)
    sent = order[~like[:-1] & (m[text[order]] > 1) & (place[order] < starts[text[order]])]
    lone = ~(repeats | many[text])[sent]
    a, b = _digests(data, sent, window)
    of = text[sent]
    by = np.lexsort((a, h[of]))
    sent, lone, a, b, of = sent[by], lone[by], a[by], b[by], of[by]
    keys = _words_of(rows.column(3))
    heads = np.flatnonzero(np.append(True, h[of][1:] != h[of][:-1])) if len(of) else []
    for low, high in zip(heads, [*heads[1:], len(of)]):
        parts = int(m[of[low]])
        borders = [(k << 64) // parts for k in range(1, parts)]
        inner = low + np.searchsorted(a[low:high], np.array(borders, np.uint64))
        for part, (x, y) in enumerate(zip([low, *inner], [*inner, high])):
            if x < y:
                first = np.where(lone[x:y], base[of[x:y]] + place[sent[x:y]], -1).astype(np.int64)
                row = [None, None, None, int(h[of[x]]), part, a[x:y].tobytes(), b[x:y].tobytes(), keys[of[x:y]].tobytes(), first.tobytes()]
                out.append(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out[0].schema)], names=SHARD.names))
    return out


def _once(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Without occurrences that came twice (copies of a text in two tasks)."""
    key, start = _words_of(rows.column(3)), rows.column(4).to_numpy(zero_copy_only=False)
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1) | (start[1:] != start[:-1])
    return rows if new.all() else rows.filter(pa.array(new))


def search_shards(rows: DataFrame, window: int) -> DataFrame:
    """``SHARD`` rows of ``CONTEXT`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.whole_groups(batches, ("h", "salt"), lambda rows: pc.binary_length(rows.column("bytes")), SHARD_BYTES):
            yield from _shard(_once(group), window)

    ordered = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "key", "start")
    return ordered.mapInArrow(run, SHARD)


class _Run:
    """Distinct windows in the order of their digests; ``start`` is -1 where the window is known
    to repeat."""

    def __init__(self, a: bytes, b: bytes, keys: bytes, starts: bytes):
        self.a, self.b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        self.key = np.frombuffer(keys, np.uint64).reshape(-1, 2)
        self.start = np.frombuffer(starts, np.int64).copy()

    def merge(self, other: _Run, hits: list) -> _Run:
        """Both runs as one; what was alone in its run and is in the other goes to ``hits``."""
        at = np.searchsorted(self.a, other.a)
        near = np.minimum(at, len(self.a) - 1)
        same = (self.a[near] == other.a) & (self.b[near] == other.b)
        mine, theirs = near[same], np.flatnonzero(same)
        for run, found in ((self, mine), (other, theirs)):
            found = found[run.start[found] >= 0]
            hits.append((run.key[found], run.start[found]))
        self.start[mine] = -1
        at = at[~same]
        for name in ("a", "b", "key", "start"):
            setattr(self, name, np.insert(getattr(self, name), at, getattr(other, name)[~same], axis=0))
        return self


def merge_shards(rows: DataFrame) -> DataFrame:
    """``MARK`` rows: windows that repeat across shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.whole_groups(batches, ("h", "part"), lambda rows: pc.binary_length(rows.column("a")), 1):
            runs = [_Run(*(group.column(c)[i].as_py() for c in ("a", "b", "keys", "starts"))) for i in range(group.num_rows)]
            hits: list = []
            while len(runs) > 1:
                pairs = zip(runs[::2], runs[1::2])
                runs = [x.merge(y, hits) for x, y in pairs] + runs[len(runs) & ~1 :]
            for key, start in hits:
                columns = [pa.array([k.tobytes() for k in key], pa.binary()), pa.array(start, pa.int32()), pa.array(np.ones(len(start)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=MARK.names)

    ordered = rows.select("h", "part", "a", "b", "keys", "starts").repartition("h", "part").sortWithinPartitions("h", "part")
    return ordered.mapInArrow(run, MARK)


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``MARK`` rows of ``texts (key, text)``: the windows of a text from ``start`` on, ``n`` of them, repeat."""
    found = pin(judge(find_anchors(texts, window, gram)), "anchors")
    shards = pin(search_shards(contexts(texts, found.where("h IS NOT NULL"), window, hot), window), "shards")
    return (
        found.where("h IS NULL").select(*MARK.names)
        .union(shards.where("part IS NULL").select(*MARK.names))
        .union(merge_shards(shards.where("part IS NOT NULL")))
    )


def _spans(starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows cover."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order]
    end = np.maximum.accumulate(begin + counts[order] + window - 1)
    first = np.ones(len(begin), bool)
    first[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(first)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(begin) else end


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` with the struct ``cut``: the bytes kept, number of bytes, of removed bytes, and of
    maximal removed runs."""
    if not 8 <= gram <= window:
        raise ValueError("an anchor has 8 bytes at least and is no longer than a window")
    W.bound_batches(docs.sparkSession)
    docs = docs.drop("cut")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    texts = docs.select(key.alias("key"), text.alias("text"))
    marks = repeated_windows(texts, window, gram, hot)
    by_text = marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    own, theirs = W.fresh(docs, "text_key"), W.fresh(docs, "marks")
    schema = T.StructType([*docs.schema.fields, T.StructField("cut", CUT)])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                texts, marks = part.column(place), part.column(part.num_columns - 1)
                values = []
                for value, found in zip(texts, marks):
                    data = value.as_buffer().to_pybytes() if value.is_valid else b""
                    begin = end = np.zeros(0, np.int64)
                    if found.is_valid:
                        begin, end = _spans(*(found.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)), window)
                    keep = zip([0, *end.tolist()], [*begin.tolist(), len(data)])
                    kept = b"".join([data[x:y] for x, y in keep])
                    values.append((kept, len(data), len(data) - len(kept), len(begin)))
                arrays = [pa.array([v[k] for v in values], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.StructArray.from_arrays(arrays, names=CUT.names)], names=schema.names)

    marked = docs.withColumn(own, key).join(by_text.withColumnRenamed("key", own).withColumnRenamed("marks", theirs), own, "left")
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(theirs)).mapInArrow(run, schema)
