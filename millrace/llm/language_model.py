"""Language-model scores from a weighted backoff automaton.

Tokens are the words between ASCII blanks, A-Z lower-cased, and one end after each text;
a 64-bit hash stands for a word. The model is a smoothed trigram: absolute discounting,
and backing off to shorter contexts with weights that make every context sum to one. At
the root stands the smoothed unigram distribution over all training words.

As an automaton: a state is a context that has arcs; an arc consumes a word, carries its
log probability and leads to the longest context that is a state; a word without an arc
takes the failure arc, which carries the backoff weight and leads to the next shorter
context, and tries again. A text is walked once from left to right. Many stretches of
text are walked in step, a stretch beginning with the words before it, as many as the
longest context, to reach its first state.

Counts are complete: every training word is counted, and every n-gram that occurs
``MIN_COUNT`` times or more, whatever the corpus; they are written tables that grow with it.
In the sum of a text's log probabilities each n-gram has a weight of its own: what its arc
gives beyond failing from its context, and its backoff weight, since every word but the end
is followed by one. So the n-grams of relative frequency ``NGRAM_SHARE`` or more and the
words of ``WORD_SHARE`` or more (at most one over the share of them, whatever the corpus)
are broadcast as an automaton, and the weights of all others are joined by hash and added.
What is left to join is rare, so no key is heavy; it is dealt by the leading bits of the keys,
in sorted runs of bytes, and found by binary search. Bitmaps of bounded size leave out n-grams
that are surely not in a table; they decide nothing else. Tables go when what follows is written.

Defined results: null and empty texts have the end only; repeated documents count as often
as they occur and each get a row; a null id is part of the training rows; without training
rows every token has probability one; an empty table gives an empty table. Columns are chosen by name;
others are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm import words as W
from millrace.llm.quality import held_out
from millrace.session import pin, unpin

ORDER = 3
WORD_SHARE = 3e-7
NGRAM_SHARE = 1e-6  # both only say what is broadcast
MIN_COUNT = 2  # of an n-gram of two words or more
SIEVE_BITS = 1 << 27
DISCOUNT = 0.5
ADDED = 0.1  # to every unigram count
PARTS = 10  # one in so many documents is held out
STRETCH = 128
FLUSH = 1_000_000
END = int(W.hashes(np.frombuffer(b" end", np.uint8), np.array([0]), np.array([4]))[0])  # no word has a blank


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's tokens begin (one more at the end)."""
    data, offsets = W.flat(texts)
    data = W.LOWER[data]
    starts, ends, bounds = W.places(data, offsets, W.BLANK_WORD)
    h = W.hashes(data, starts, ends)
    return np.insert(h, bounds[1:], np.uint64(END)), bounds + np.arange(len(bounds))


def gram_keys(h: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 2, ..., ``order`` the n-grams of all texts: key, keys of the n-gram
    without its last and without its first word, and the place of its last word. The key
    of a word is its hash."""
    begins = np.zeros(len(h), bool)
    begins[bounds[:-1][bounds[:-1] < len(h)]] = True
    keys, at, out = h, np.arange(len(h)), []
    for _ in range(2, order + 1):
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & ~begins[at[1:]]) + 1
        a, b = keys[follows - 1], keys[follows]
        keys, at = W.combined(a, b), at[follows]
        out.append((keys, a, b, at))
    return out


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal keys (the first array) made one; the last array is summed."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = W.order_of(columns[0])
    columns = [c[order] for c in columns]
    keys = columns[0]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(columns[-1], first) if len(first) else columns[-1]
    return (*[c[first] for c in columns[:-1]], total)


def part_bits(docs: DataFrame) -> int:
    """Keys are dealt by so many leading bits: a few parts for each shuffle partition."""
    return max(4, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


SORTED = ("key", "keys", "owners")  # columns that go as differences


def _bytes(name: str, x: np.ndarray) -> bytes:
    """An array as the planes of its bytes, one after another, compressed: what all values have in
    common takes nothing, and what they have in part takes its entropy."""
    if name in SORTED:
        x = np.diff(x, prepend=x.dtype.type(0))
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)
    planes = np.empty(rows.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):  # several times as fast as all at once
        plane[:] = rows[:, i]
    return zstandard.compress(planes, 1)


def _array(name: str, data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    x = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        x[:, i] = plane
    x = x.view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if name in SORTED else x


def _packed(bits: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Arrays in the order of ``keys`` as one row ``(part, column...)`` for each part, in bytes."""
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cuts = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
    parts = np.flatnonzero(np.diff(cuts))
    spans = list(zip(cuts[parts].tolist(), cuts[parts + 1].tolist()))
    bytes_ = [pa.array([_bytes(n, c[x:y]) for x, y in spans], pa.binary()) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *bytes_], names=["part", *columns])


def _unpacked(rows: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    found = [_array(name, v, dtype) for v in rows.column(name).to_pylist() if v is not None]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def _by_part(rows: DataFrame, *then: str) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", *then)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One group after the other."""
    return W.whole_groups(batches, (key,), lambda rows: pa.array(np.ones(rows.num_rows, np.int64)), 1)


def _count(docs: DataFrame, pick: Callable, names: list[str], least: float = 1) -> DataFrame:
    """``(names..., n)`` of what ``pick`` gives for a text array, arrays called ``names``, the first
    of them the key, that occurs ``least`` times. Tasks sum what they meet and send it in bytes, a
    row for each part of the keys; the parts say what the key is."""
    W.bound_batches(docs.sparkSession)
    bits, sent = part_bits(docs), names[1:] or names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            *columns, n = _summed(parts)
            return _packed(bits, columns[0], dict(zip(sent, columns[1:] or columns)) | {"n": n.astype(np.uint32)})

        for batch in batches:
            for part in W.slices(batch, "text"):
                columns = pick(part.column(0))
                parts.append(_summed([(*columns, np.ones(len(columns[0]), np.int64))]))
                n = parts[-1][-1]
                size += len(n)
                if len(parts) > 1 and len(n) * 4 > len(parts[0][0]):
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                if size > FLUSH:
                    yield flushed()
                    parts, size = [], 0
        if parts:
            yield flushed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "part"):
            columns = [_unpacked(group, c, np.uint64) for c in sent]
            keys = columns if len(names) == 1 else [W.combined(*columns), *columns]
            *columns, n = _summed([(*keys, _unpacked(group, "n", np.uint32).astype(np.int64))])
            kept = n >= least
            yield pa.RecordBatch.from_arrays([*[pa.array(c[kept].view(np.int64)) for c in columns], pa.array(n[kept])], names=[*names, "n"])

    packed = docs.select("text").mapInArrow(count, "part int, " + "".join(f"{c} binary, " for c in sent) + "n binary")
    return _by_part(packed).mapInArrow(add, "".join(f"{c} long, " for c in names) + "n long")


def sieve(keys: DataFrame, size: int) -> np.ndarray:
    """Bitmap that has the bit of every ``key`` of a table of ``size`` rows set; it takes
    ``SIEVE_BITS`` at most, and then lets more other keys through. The leading bits of a key say
    which bit; tasks send the places of the bits they meet, a row for each part of the bitmap."""
    width = max(10, min(SIEVE_BITS, 16 * max(size, 1)).bit_length() - 1)
    bits = min(part_bits(keys), width - 6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            place = np.sort(np.concatenate(held).view(np.uint64) >> np.uint64(64 - width))
            place = place[np.append(True, place[1:] != place[:-1])]
            return _packed(bits, place << np.uint64(64 - width), {"keys": place.astype(np.uint32)})

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size > FLUSH:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "part"):
            part = np.zeros(1 << (width - bits), np.uint8)
            part[_unpacked(group, "keys", np.uint32) & np.uint32(len(part) - 1)] = 1
            bitmap = np.packbits(part, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([group.column("part")[:1], pa.array([bitmap], pa.binary())], names=["part", "bitmap"])

    with W.number_batches(keys.sparkSession):
        marked = keys.select("key").mapInArrow(mark, "part int, keys binary")
        got = _by_part(marked).mapInArrow(put, "part int, bitmap binary").toArrow()
    out = np.zeros((1 << bits, 1 << (width - bits - 6)), np.uint64)
    for part, bitmap in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[part] = np.frombuffer(bitmap, np.uint64)
    return out.ravel()


def passes(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(65 - (64 * len(bitmap)).bit_length())
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def handed_out(sc: SparkContext, value) -> Broadcast:
    """Broadcast of ``value``, compressed: executors keep what they get in files too."""
    return sc.broadcast((uuid.uuid4().hex, zstandard.compress(pickle.dumps(value, 5), 3)))


_taken: dict[str, object] = {}


def taken(shared: Broadcast):
    """The value handed out last, unpacked once by a Python worker."""
    key, data = shared.value
    if key not in _taken:
        _taken.clear()
        _taken[key] = pickle.loads(zstandard.decompress(data))
    return _taken[key]


def arc_keys(state: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    return W.mixed((state * (words + 1) + word).astype(np.uint64))


@dataclass
class Automaton:
    """``words``: sorted hashes; ``count``: their counts. States are numbered, the
    root is 0. ``arcs``: sorted hashes (one to one) of ``state * (len(words) + 1) + word`` with
    ``arc_logp`` and ``arc_next``; ``backoff`` and ``fail`` by state; ``root_logp``, ``root_next`` by word."""

    words: np.ndarray
    count: np.ndarray
    total: float
    distinct: float
    arcs: np.ndarray
    arc_logp: np.ndarray
    arc_next: np.ndarray
    backoff: np.ndarray
    fail: np.ndarray
    root_logp: np.ndarray
    root_next: np.ndarray
    order: int

    @cached_property
    def word_at(self) -> W.Places:
        return W.Places(self.words)

    @cached_property
    def arc_at(self) -> W.Places:
        return W.Places(self.arcs)

    @property
    def norm(self) -> float:
        return float(np.log10(self.total + ADDED * (self.distinct + 1)))

    def walk(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Summed log10 probability of each text, words outside the table left out
        (their arc at the root has weight 0 here)."""
        lead = self.order - 1
        size = np.diff(bounds)
        pieces = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = bounds[doc] + number * STRETCH
        stop = np.minimum(begin + STRETCH, bounds[doc + 1])
        at = np.maximum(begin - lead, bounds[doc])
        length = stop - at
        order = np.argsort(-length, kind="stable")
        at, begin, stop = at[order], begin[order], stop[order]
        length = length[order]
        state = np.zeros(len(at), np.int64)
        total = np.zeros(len(at))
        step = 0
        while len(at) and step < length[0]:
            n = int(np.searchsorted(-length, -step, "left"))  # stretches longer than step
            logp, state[:n] = self.step(state[:n], words[at[:n] + step])
            total[:n] += np.where(at[:n] + step >= begin[:n], logp, 0.0)
            step += 1
        return np.bincount(doc[order], total, minlength=len(size)).astype(np.float64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Consume a word in each state: its log probability and the next state."""
        state = state.copy()
        logp = np.zeros(len(state))
        nxt = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(state)
        at_root = state == 0
        while len(todo):
            place = self.arc_at(arc_keys(state[todo], word[todo], len(self.words)))
            hit = place >= 0
            done, arc = todo[hit], place[hit]
            logp[done] += self.arc_logp[arc]
            nxt[done] = self.arc_next[arc]
            todo = todo[~hit]
            logp[todo] += self.backoff[state[todo]]
            state[todo] = self.fail[state[todo]]
            at_root[todo] = state[todo] == 0
            todo = todo[state[todo] != 0]
        logp[at_root] += self.root_logp[word[at_root]]
        nxt[at_root] = self.root_next[word[at_root]]
        return logp, nxt


@dataclass
class Model:
    """``head``: the automaton of what is frequent; ``keys``: sorted keys of its n-grams for
    n = 2, 3, ...; ``sieves``: bitmaps of the keys in ``tail``, by n; ``tail``: a written table of the
    other words and n-grams, a row for each part of the keys, ``bits`` of them: ``keys`` in order,
    the weight of each (``extra``), which of them are words (``word_at``), and what those
    add to an unknown word's log count (``base``)."""

    head: Automaton
    keys: list[np.ndarray]
    sieves: list[np.ndarray]
    tail: DataFrame
    bits: int


def _columns(table: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of bounded size, sorted by the first, a key."""
    got = table.select(*names).toArrow()
    out = [got.column(i).to_numpy() for i in range(len(names))]
    out[0] = out[0].view(np.uint64)
    order = np.argsort(out[0])
    return [c[order] for c in out]


def head_automaton(
    words: np.ndarray, count: np.ndarray, word_backoff: np.ndarray, total: float, distinct: float, grams: list[list[np.ndarray]]
) -> Automaton:
    """``grams``: for n = 2, 3, ... sorted keys, keys of the beginning and of the end, gain
    (log probability of the arc less that of failing), backoff. Beginnings and ends are
    among the shorter ones. Every word and n-gram but the longest is a state."""
    size, order = len(words), len(grams) + 1
    norm = np.log10(total + ADDED * (distinct + 1))
    root_logp = np.log10(count + ADDED) - norm
    keys, logp, backoffs, offset = words, root_logp, word_backoff, 1  # of the shorter ones
    last, state_end = np.arange(size), np.zeros(size, np.int64)
    backoff, fail = [np.zeros(1), word_backoff], [np.zeros(1, np.int64), state_end]
    arcs, arc_logp, arc_next = [], [], []
    for n, (key, begin, end, gain, bo) in enumerate(grams, 2):
        a, b = W.look_up(begin.view(np.uint64), keys), W.look_up(end.view(np.uint64), keys)
        last = last[b]
        arcs.append(arc_keys(offset + a, last, size))
        logp = gain + backoffs[a] + logp[b]
        arc_logp.append(logp)
        if n < order:
            arc_next.append(offset + len(keys) + np.arange(len(key)))
            backoff.append(bo)
            fail.append(offset + b)
            offset += len(keys)
        else:
            arc_next.append(offset + b)
        keys, backoffs = key, bo
    arcs, by = np.concatenate(arcs), np.argsort(np.concatenate(arcs))
    return Automaton(
        words, count, total, distinct, arcs[by], np.concatenate(arc_logp)[by], np.concatenate(arc_next)[by],
        np.concatenate(backoff), np.concatenate(fail), np.append(root_logp, 0.0), np.append(1 + np.arange(size), 0), order,
    )


def train(
    docs: DataFrame,
    word_share: float | None = None,
    ngram_share: float | None = None,
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    head_word_share: float = WORD_SHARE,
    head_share: float = NGRAM_SHARE,
) -> Model:
    """The model of training texts ``docs (text)``. N-grams of ``min_count`` occurrences are
    kept or, if a caller gives shares, those of ``ngram_share`` of the tokens whose words all
    have ``word_share``."""
    sc = docs.sparkSession.sparkContext
    counts = pin(_count(docs, lambda texts: [tokens(texts)[0]], ["key"]), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = total + ADDED * (distinct + 1)
    least = min_count if ngram_share is None else ngram_share * total
    strong = head_share * total
    # Of the shorter n-grams: key, n, and (low / whole) the probability of the last word.
    lower = counts.withColumns({"low": F.col("n") + F.lit(ADDED), "whole": F.lit(float(norm))})
    inside = counts.where(F.col("n") >= (least if word_share is None else word_share * total))
    tables, backoffs, written = [], [], [counts]
    for n in range(2, order + 1):
        shared = handed_out(sc, sieve(inside, inside.count()))

        def pick(texts: pa.Array, n=n, shared=shared):
            key, a, b, _ = gram_keys(*tokens(texts), n)[-1]
            bitmap = taken(shared)
            good = passes(a, bitmap) & passes(b, bitmap)
            return key[good], a[good], b[good]

        found = _count(docs, pick, ["key", "a", "b"], least)
        if n == 2 and word_share is not None:
            for c in ("a", "b"):
                found = found.join(inside.select(F.col("key").alias(c)), c, "left_semi")
        found = pin(found, "gram-counts")
        shared.destroy()
        # Written, as both the contexts and the weights are made of it. Frequent n-grams alone
        # are ever asked what they begin and end with.
        frequent = F.col("n") >= strong
        ends = found.join(lower.select(F.col("key").alias("b"), "low", "whole"), "b")
        ends = pin(ends.select("key", "a", F.when(frequent, F.col("b")).alias("b"), "n", "low", "whole"), "gram-ends")
        unpin(found)
        sums = ends.groupBy("a").agg(
            F.sum("n").alias("_n"), F.count("*").alias("_kinds"), F.sum("low").alias("_low"), F.max("whole").alias("whole")
        )
        left = F.col("n") - F.col("_n") + F.lit(DISCOUNT) * F.col("_kinds")
        rest = (F.col("whole") - F.col("_low")) / F.col("whole")
        contexts = sums.join(lower.select(F.col("key").alias("a"), "n"), "a").select(
            "a", F.col("n").alias("context"), (F.log10(left / F.col("n")) - F.log10(rest)).alias("backoff")
        )
        contexts = pin(contexts, "contexts")
        gain = F.log10((F.col("n") - F.lit(DISCOUNT)) / F.col("context")) - F.col("backoff") - F.log10(F.col("low") / F.col("whole"))
        begin, whole = F.when(frequent, F.col("a")).alias("a"), [F.col("context").cast("double").alias("whole")] if n < order else []
        table = pin(ends.join(contexts, "a").select("key", begin, "b", "n", gain.alias("gain"), *whole), "grams")
        unpin(ends)
        tables.append(table)
        written += [table, contexts]
        backoffs.append(contexts.select(F.col("a").alias("key"), "context", "backoff"))
        if n == order:
            break
        lower = table.select("key", "n", (F.col("n") - F.lit(DISCOUNT)).alias("low"), "whole")
        inside = table
    # Words and n-grams below these are joined.
    floors = [min(head_word_share, head_share) * total] + [strong] * (order - 1)
    words, count = _columns(counts.where(F.col("n") >= floors[0]), "key", "n")
    grams = [_columns(t.where(F.col("n") >= strong), "key", "a", "b", "gain") for t in tables]
    shorter = []
    for keys, table, floor in zip([words, *[g[0] for g in grams]], backoffs, floors):
        key, backoff = _columns(table.where(F.col("context") >= floor), "key", "backoff")
        shorter.append(np.zeros(len(keys)))
        shorter[-1][W.look_up(key, keys)] = backoff
    log_count = F.log10(F.col("n") + F.lit(ADDED)) - F.lit(float(np.log10(ADDED)))
    rare_words = counts.where(F.col("n") < floors[0]).select("key", log_count.alias("base"))
    rare = [t.where(F.col("n") < strong).select("key", "gain") for t in tables]
    weights = rare + [t.where(F.col("context") < floor).select("key", "backoff") for t, floor in zip(backoffs, floors)]
    sieves = [sieve(t, t.count()) for t in rare]
    grams = [[*g, bo] for g, bo in zip(grams, [*shorter[1:], None])]
    head = head_automaton(words, count, shorter[0], float(total), float(distinct), grams)
    bits = part_bits(docs)
    with W.number_batches(docs.sparkSession):
        packed = pin(_packed_tail(rare_words, weights, bits), "tail")
    unpin(*written)
    return Model(head, [g[0] for g in grams], sieves, packed, bits)


TAIL = "part int, keys binary, extra binary, word_at binary, base binary"


def _packed_tail(words: DataFrame, weights: list[DataFrame], bits: int) -> DataFrame:
    """``TAIL`` rows of ``words (key, base)``, each once, and of tables ``(key, weight)``, weights of
    one key added up."""
    sent = "part int, keys binary, base binary, extra binary"

    def packed(table: DataFrame, name: str) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flushed() -> pa.RecordBatch:
                keys, values = (np.concatenate(c) for c in zip(*held))
                keys = keys.view(np.uint64)
                order = W.order_of(keys)
                rows = _packed(bits, keys[order], {"keys": keys[order], name: values[order]})
                return _nulls(schema, rows.num_rows, **dict(zip(rows.schema.names, rows.columns)))

            for batch in batches:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
                if size > FLUSH:
                    yield flushed()
                    held, size = [], 0
            if size:
                yield flushed()

        return table.mapInArrow(pack, schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "part"):
            is_word = pc.is_valid(group.column("base"))
            known, others = group.filter(is_word), group.filter(pc.invert(is_word))
            word, base = _unpacked(known, "keys", np.uint64), _unpacked(known, "base", np.float64)
            gains = np.concatenate([np.zeros(len(word)), _unpacked(others, "extra", np.float64)])
            keys, extra = _summed([(np.concatenate([word, _unpacked(others, "keys", np.uint64)]), gains)])
            order = np.argsort(word)
            at = np.searchsorted(keys, word[order])
            row = dict(zip(_names(TAIL)[1:], (keys, extra, at.astype(np.uint32), base[order])))
            yield pa.RecordBatch.from_arrays([group.column("part")[:1], *[pa.array([_bytes(n, x)], pa.binary()) for n, x in row.items()]], names=_names(TAIL))

    schema = T.StructType(_fields(sent))
    rows = packed(words, "base")
    for table in weights:
        rows = rows.union(packed(table, "extra"))
    return _by_part(rows).mapInArrow(add, TAIL)


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


@dataclass
class Scored:
    """Of each text of a slice what the automaton gives; and the words and n-grams that it does not
    have, as often as they occur, with the text they are in."""

    n_tokens: np.ndarray
    known: np.ndarray
    base: np.ndarray
    walked: np.ndarray
    keys: np.ndarray
    owner: np.ndarray


def partial_scores(texts: pa.Array, model: Automaton, keys: list[np.ndarray], sieves: list[np.ndarray]) -> Scored:
    h, bounds = tokens(texts)
    docs = len(texts)
    ids = model.word_at(h)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    inside = ids >= 0
    logs = np.log10(model.count + ADDED)
    base = np.bincount(doc[inside], logs[ids[inside]], minlength=docs).astype(np.float64)  # no words: integers
    known = np.bincount(doc[inside], minlength=docs)
    walked = model.walk(np.where(inside, ids, len(model.words)), bounds)
    rare, owner = [h[~inside]], [doc[~inside]]
    for (key, _, _, at), frequent, bitmap in zip(gram_keys(h, bounds, model.order), keys, sieves):
        maybe = passes(key, bitmap)
        key, at = key[maybe], at[maybe]
        maybe = W.look_up(key, frequent) < 0
        rare.append(key[maybe])
        owner.append(doc[at[maybe]])
    return Scored(np.diff(bounds), known, base, walked, np.concatenate(rare), np.concatenate(owner))


SCANNED = "kind int, part int, first long, row long, n_tokens long, known long, base double, walked double, keys binary, a binary, b binary, c binary"
TAIL_ROW, RARE_ROW, TEXT_ROW = range(3)
SUMS = "first long, row long, n_tokens long, known long, base double, walked double, owners binary, bases binary, knowns binary, extras binary"
SUMS_HELD = 1 << 20  # texts whose sums a task holds


def _nulls(schema: T.StructType, n: int, **columns) -> pa.RecordBatch:
    """Rows of ``schema`` in which only ``columns`` are given."""
    shape = to_arrow_schema(schema)
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in shape]
    arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, shape)]
    return pa.RecordBatch.from_arrays(arrays, names=shape.names)


def _scan(docs: DataFrame, model: Model) -> DataFrame:
    """``SCANNED`` rows of ``docs (doc, text, row)``: texts with what the automaton gives, and the
    rest of their words and n-grams by part, in runs of texts that begin with the row ``first``."""
    shared = handed_out(docs.sparkSession.sparkContext, (model.head, model.keys, model.sieves))
    bits = model.bits
    schema = T.StructType([T.StructField("doc", docs.schema["doc"].dataType), *_fields(SCANNED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = None, [], 0

        def flushed() -> pa.RecordBatch:
            keys, owner = (np.concatenate(c) for c in zip(*held))
            order = W.order_of(keys)
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(keys)))
            columns = {"keys": keys[at], "a": (owner[at] - first).astype(np.uint32), "b": times.astype(np.uint32)}
            rows = _packed(bits, keys[at], columns)
            n = rows.num_rows
            given = dict(zip(rows.schema.names, rows.columns))
            return _nulls(schema, n, kind=pa.array(np.full(n, RARE_ROW)), first=pa.array(np.full(n, first)), **given)

        for batch in batches:
            for part in W.slices(batch, "text"):
                row = part.column(2).to_numpy()
                first = row[0] if first is None else first
                x = partial_scores(part.column(1), *taken(shared))
                n = len(row)
                yield _nulls(
                    schema, n, doc=part.column(0), kind=pa.array(np.full(n, TEXT_ROW)), part=pa.array(row % (1 << bits)),
                    first=pa.array(np.full(n, first)), row=part.column(2), n_tokens=pa.array(x.n_tokens), known=pa.array(x.known),
                    base=pa.array(x.base, pa.float64()), walked=pa.array(x.walked, pa.float64()),
                )
                held.append((x.keys, row[x.owner]))
                size += len(x.keys)
                if size > FLUSH:
                    yield flushed()
                    first, held, size = None, [], 0
        if held:
            yield flushed()

    return docs.mapInArrow(run, schema)


def _fields(ddl: str) -> list[T.StructField]:
    types = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return [T.StructField(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))]


def _add_tail(scanned: DataFrame, model: Model) -> DataFrame:
    """``SUMS`` rows: texts as they were, and for runs of texts what the tail adds."""
    tail = model.tail.select(F.lit(TAIL_ROW).alias("kind"), "part", "keys", F.col("word_at").alias("a"), F.col("base").alias("b"), F.col("extra").alias("c"))
    rows = _by_part(scanned.unionByName(tail, allowMissingColumns=True), "kind")
    schema = T.StructType([T.StructField("doc", scanned.schema["doc"].dataType), *_fields(SUMS)])
    text_columns = ["doc", "first", "row", "n_tokens", "known", "base", "walked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            first, packed = [], {"owners": [], "bases": [], "knowns": [], "extras": []}
            for run, parts in held.items():
                owner, base, known, extra = (np.concatenate(c) for c in zip(*parts))
                owners, place = np.unique(owner, return_inverse=True)
                first.append(run)
                sums = [np.bincount(place, x, len(owners)) for x in (base, known, extra)]
                for name, x in zip(packed, (owners.astype(np.uint32), sums[0], sums[1].astype(np.int32), sums[2])):
                    packed[name].append(_bytes(name, x))
            return _nulls(schema, len(first), first=pa.array(first, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in packed.items()})

        for group in _groups(batches, "part"):
            kind = group.column("kind").to_numpy()
            texts = pa.array(np.flatnonzero(kind == TEXT_ROW))
            if len(texts):
                found = group.select(text_columns).take(texts)
                yield _nulls(schema, len(texts), **dict(zip(text_columns, found.columns)))
            tails = group.filter(pa.array(kind == TAIL_ROW))
            if not tails.num_rows:
                continue
            keys, extras = _unpacked(tails, "keys", np.uint64), _unpacked(tails, "c", np.float64)
            bases, knowns = np.zeros(len(keys)), np.zeros(len(keys))
            words = _unpacked(tails, "a", np.uint32)
            bases[words], knowns[words] = _unpacked(tails, "b", np.float64), 1
            for i in np.flatnonzero(kind == RARE_ROW).tolist():
                rare = group.slice(i, 1)
                at = W.look_up(_unpacked(rare, "keys", np.uint64), keys)
                hit = at >= 0
                at, times = at[hit], _unpacked(rare, "b", np.uint32)[hit]
                owner = _unpacked(rare, "a", np.uint32)[hit]
                owners, place = np.unique(owner, return_inverse=True)
                sums = [np.bincount(place, times * x[at], len(owners)).astype(np.float64) for x in (bases, knowns, extras)]
                held.setdefault(group.column("first")[i].as_py(), []).append((owners, *sums))
                size += len(owners)
            if size > SUMS_HELD:
                yield flushed()
                held, size = {}, 0
        if held:
            yield flushed()

    return rows.mapInArrow(run, schema)


RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score."""
    W.bound_batches(docs.sparkSession)
    fields = _fields(RESULT)
    kept = [c for c in docs.columns if c not in (text_col, *_names(RESULT))]
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_nothing"))
    rows = docs.select(doc.alias("doc"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    sums = _add_tail(_scan(rows, model), model)
    schema = T.StructType([T.StructField("doc", sums.schema["doc"].dataType), *fields])
    total, norm, unknown = int(model.head.total), model.head.norm, float(np.log10(ADDED))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "first"):
            is_text = pc.is_valid(group.column("row"))
            texts, added = group.filter(is_text), group.filter(pc.invert(is_text))
            owner = texts.column("row").to_numpy() - texts.column("first").to_numpy()
            base, known, extra = (np.zeros(int(owner.max()) + 1) for _ in range(3))
            at = _unpacked(added, "owners", np.uint32)
            for total_, name, kind in ((base, "bases", np.float64), (known, "knowns", np.int32), (extra, "extras", np.float64)):
                np.add.at(total_, at, _unpacked(added, name, kind))
            n, inside = (texts.column(c).to_numpy() for c in ("n_tokens", "known"))
            rare = base[owner] + (n - inside) * unknown
            yield _nulls(
                schema, len(n), doc=texts.column("doc"), n_tokens=pa.array(n), n_known=pa.array(inside + known[owner].astype(np.int64)),
                train_tokens=pa.array(np.full(len(n), total)),
                base_score=pa.array(texts.column("base").to_numpy() + rare - n * norm),
                score=pa.array(texts.column("walked").to_numpy() + rare - (n - inside) * norm + extra[owner]),
            )

    done = sums.repartition("first").sortWithinPartitions("first").mapInArrow(finish, schema)
    return done.select(*([F.col(f"doc.`{c}`") for c in kept]), *[f.name for f in fields])


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, **options) -> DataFrame:
    """Learn from the rows that are not held out and score all: id, held_out and
    what ``score`` adds."""
    rows = docs.select(F.col(id_col), held_out(id_col, parts).alias("held_out"), F.col(text_col).alias("text"))
    model = train(rows.where(~F.col("held_out")).select("text"), **options)
    return score(rows, model)
