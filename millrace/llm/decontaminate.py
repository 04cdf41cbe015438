"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton is built over the words of all items of a block of the test set. A
document's words stream through it; the state and the longest matching length at
every word say which windows of ``WINDOW`` item words (or whole shorter items) end
there. Words are first looked up in the items' vocabulary, and pairs of words in the
items' pairs, on whole columns: only runs in which every pair occurs in some item
can hold a window, and only those are walked.

The test set is dealt to blocks of about ``BLOCK_WORDS`` words, so what is sent to the executors
at once is bounded; an item too long for that is cut into pieces that share all but one word
of a window, which have the same windows. Tasks build the automata, a block each, once,
into a written table; every block passes over all documents.

Defined results: null or empty text has no words; a null or wordless item matches
nothing; items without an id count as one item with an empty id; equal item ids are
one item; repeated documents each get a row; an empty table gives an empty table.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.session import pin

WINDOW = 10
BLOCK_WORDS = 500_000
MAX_COVERAGE = 0.8

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _item_words(text: str | None) -> np.ndarray:
    data, offsets = W.flat(pa.array([text], pa.string()))
    data = W.LOWER[data]
    starts, ends, _ = W.places(data, offsets, W.PLAIN_WORD)
    return W.hashes(data, starts, ends)


class Automaton:
    """Generalised suffix automaton of items given as (id, word hashes)."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, W.look_up(w, self.vocabulary).tolist()) for name, w in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        pairs = {a * len(self.vocabulary) + b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.shortest = min((min(len(c), window) for _, c in coded if c), default=window)
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            for state, length in self.walk(codes):
                if length >= window:
                    self.window_items.setdefault(self._window_state(state), set()).add(name)
            if 0 < len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.short_items.setdefault(state, []).append((len(codes), name))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after every word."""
        state = length = 0
        for c in codes:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield state, length

    def runs(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of words within one document that may hold a window."""
        known = codes >= 0
        joined = np.zeros(len(codes), bool)  # with the word before
        if len(codes) > 1:
            both = np.flatnonzero(known[:-1] & known[1:])
            pair = codes[both] * len(self.vocabulary) + codes[both + 1]
            joined[both[W.look_up(pair, self.pairs) >= 0] + 1] = True
            inner = bounds[1:-1]
            joined[inner[inner < len(codes)]] = False
        first = np.flatnonzero(known & ~joined)
        goes_on = np.zeros(len(codes), bool)
        goes_on[:-1] = joined[1:]
        end = np.flatnonzero(known & ~goes_on) + 1
        long = end - first >= self.shortest
        return first[long], end[long]

    def search(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))

        for i, (state, length) in enumerate(self.walk(codes)):
            if length >= self.window:
                items |= self.window_items[self._window_state(state)]
                hit(i - self.window + 1, i + 1)
            if self.short_items:
                while state > 0:
                    for n, name in self.short_items.get(state, ()):
                        if n <= length:
                            items.add(name)
                            hit(i - n + 1, i + 1)
                    state = self.link[state]
                    length = min(length, self.length[state])
        return spans, items


PIECE = "name string, words binary"
BLOCK = "block int, automaton binary"


def pieces(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """``PIECE`` rows: words of items, or of parts of long ones, as hashes in bytes."""
    size = max(window, block_words // 4)
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                names, words = [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = _item_words(text)
                    for at in range(0, max(len(w) - window, 0) + 1, size - window + 1):
                        if len(w):
                            names.append(name or "")
                            words.append(w[at : at + size].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], names=["name", "words"])

    return rows.mapInArrow(run, PIECE)


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[Broadcast]:
    """The automaton of each block, as bytes that were broadcast: built by tasks, and handed on
    by the driver one at a time and unread."""
    spark = items.sparkSession
    W.bound_batches(spark)
    cut_up = pin(pieces(items, id_col, text_col, window, block_words), "item-pieces")
    total = cut_up.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total // block_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.whole_groups(batches, ("block",), lambda rows: pa.array(np.ones(rows.num_rows, np.int64)), 1):
            names, words = group.column("name").to_pylist(), group.column("words").to_pylist()
            built = Automaton([(n, np.frombuffer(w, np.uint64)) for n, w in zip(names, words)], window)
            yield pa.RecordBatch.from_arrays([group.column("block")[:1], pa.array([pickle.dumps(built, 5)], pa.large_binary()).cast(pa.binary())], names=["block", "automaton"])

    dealt = cut_up.select(F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int").alias("block"), "name", "words")
    table = pin(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(build, BLOCK), "automata")
    found = [r[0] for r in table.select("block").orderBy("block").collect()]
    empty = [] if found else [pickle.dumps(Automaton([], window), 5)]
    built = (bytes(table.where(F.col("block") == k).select("automaton").first()[0]) for k in found)
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in (*empty, *built)]


_unpickled: dict[str, Automaton] = {}


def loaded(shared: Broadcast) -> Automaton:
    """The automaton, read once by a Python worker."""
    key, data = shared.value
    if key not in _unpickled:
        _unpickled.clear()
        _unpickled[key] = pickle.loads(data)
    return _unpickled[key]


def scan_array(texts: pa.Array, automaton: Automaton) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: its number of words, hit spans (in words) and items."""
    data, offsets = W.flat(texts)
    data = W.LOWER[data]
    starts, ends, bounds = W.places(data, offsets, W.PLAIN_WORD)
    codes = W.look_up(W.hashes(data, starts, ends), automaton.vocabulary)
    found: dict[int, tuple[list, set]] = {}
    first, end = automaton.runs(codes, bounds)
    owner = np.searchsorted(bounds, first, "right") - 1
    for a, b, doc in zip(first.tolist(), end.tolist(), owner.tolist()):
        spans, items = automaton.search(codes[a:b].tolist())
        if spans:
            at = a - int(bounds[doc])
            all_spans, all_items = found.setdefault(doc, ([], set()))
            all_spans += [(s + at, e + at) for s, e in spans]
            all_items |= items
    counts = np.diff(bounds).tolist()
    return [(n, *found.get(i, ([], set()))) for i, n in enumerate(counts)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (ranges of words) and hit_items."""
    blocks = automata(items, item_id, item_text, window, block_words)
    return scan_blocks(docs, blocks, text_col)


def scan_blocks(docs: DataFrame, blocks: list[Broadcast], text_col: str) -> DataFrame:
    """``scan`` with automata that are built."""
    out = None
    docs, own, restored = W.aside(docs.drop(*[f.name for f in FOUND]), "_spans", "_items")
    text_col = own(text_col)
    for shared in blocks:
        if out is None:
            out = W.with_text_columns(docs, text_col, FOUND, lambda shared=shared: _search_with(shared))
            continue
        before = pin(out, "decontaminate")  # a further block
        both = before.withColumnsRenamed({"hit_spans": "_spans", "hit_items": "_items"})
        now = W.with_text_columns(both, text_col, FOUND, lambda shared=shared: _search_with(shared))
        joined = F.array_sort(F.concat("_spans", "hit_spans"))
        out = now.withColumns(
            {"hit_spans": merged_spans(joined), "hit_items": F.array_union("_items", "hit_items")}
        ).drop("_spans", "_items")
    return restored(out)


def merged_spans(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    nothing = F.array().cast(SPANS.simpleString())
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        spans,
        nothing,
        lambda acc, x: F.when((F.size(acc) == 0) | (x["first"] > last(acc)["end"]), F.concat(acc, F.array(x))).otherwise(
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
                ),
            )
        ),
    )


def _search_with(shared: Broadcast):
    automaton = loaded(shared)

    def work(texts: pa.Array) -> list:
        rows = scan_array(texts, automaton)
        return [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array(
                [[{"first": a, "end": b} for a, b in _merged(r[1])] for r in rows],
                pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
            ),
            pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
        ]

    return work


def report(found: DataFrame) -> DataFrame:
    """Digest columns beside what ``scan`` gives."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256),
            "contaminated": n_hit > 0,
        }
    )


def cut(text: str, n: int, spans: list[tuple[int, int]], max_coverage: float) -> str | None:
    """``text`` of ``n`` words without the words of sorted ``spans``; None if those are
    more than ``max_coverage`` of it."""
    if sum(b - a for a, b in spans) > max_coverage * n:
        return None
    raw = text.encode()
    data = W.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = W.places(data, np.array([0, len(data)]), W.PLAIN_WORD)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    kept.append(raw[at:])
    return b" ".join(kept).decode()


def without_spans(text: str, automaton: Automaton, max_coverage: float) -> str | None:
    """``text`` without the words hit, again until none is hit; None if more than
    ``max_coverage`` of its words are hit."""
    while True:
        n, spans, _ = scan_array(pa.array([text]), automaton)[0]
        if not spans:
            return text
        text = cut(text, n, _merged(spans), max_coverage)
        if text is None:
            return None


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the words that occur in windows of test items; a document
    of which more than ``max_coverage`` is hit goes. Columns stay as they are, but
    ``n_chars``, if there, follows a changed text."""
    docs, own, restored = W.aside(docs, "_clean", "_row")
    text_col = own(text_col)
    blocks = automata(items, item_id, item_text, window, block_words)
    if len(blocks) > 1:
        return restored(_put(docs, _cleaned_by_blocks(docs, blocks, text_col, max_coverage), text_col))
    mark = T.StructField("_clean", T.StructType(CLEAN))
    shared = blocks[0]

    def make():
        automaton = loaded(shared)

        def work(texts: pa.Array) -> list:
            done = []
            for i, (_, spans, _) in enumerate(scan_array(texts, automaton)):
                if not spans:
                    done.append(None)
                else:
                    new = without_spans(texts[i].as_py(), automaton, max_coverage)
                    done.append({"kept": new is not None, "text": new})
            return [pa.array(done, pa.struct([("kept", pa.bool_()), ("text", pa.string())]))]

        return work

    return restored(_put(docs, W.with_text_columns(docs, text_col, [mark], make), text_col))


CLEAN = [T.StructField("kept", T.BooleanType()), T.StructField("text", T.StringType())]


def _put(docs: DataFrame, marked: DataFrame, text_col: str) -> DataFrame:
    """``docs`` from ``marked``, which has ``_clean`` (null: nothing hit)."""
    changed = F.col("_clean").isNotNull()
    new = {text_col: F.when(changed, F.col("_clean.text")).otherwise(F.col(f"`{text_col}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_clean.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return marked.where(~changed | F.col("_clean.kept")).withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cleaned_by_blocks(docs: DataFrame, blocks: list[Broadcast], text_col: str, max_coverage: float) -> DataFrame:
    """``docs`` with ``_clean``, as one block of all items would give it: the spans of
    all blocks are found on the same text before it is judged and cut, and cut texts
    are scanned by all blocks again until none is hit."""
    base = pin(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    todo = base.select("_row", F.col(f"`{text_col}`").alias("text"))
    rounds = []

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                new = [
                    cut(r["text"], r["n_words"], [(x["first"], x["end"]) for x in r["hit_spans"]], max_coverage)
                    for r in part.to_pylist()
                ]
                clean = pa.array([{"kept": t is not None, "text": t} for t in new], pa.struct([("kept", pa.bool_()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), clean], names=["_row", "_clean"])

    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_clean", T.StructType(CLEAN))])
    while True:
        found = scan_blocks(todo, blocks, "text")
        hit = found.where(F.size("hit_spans") > 0).select("_row", "text", "n_words", "hit_spans")
        done = pin(hit.mapInArrow(cuts, schema), "decontaminate")
        rounds.append(done.withColumn("_round", F.lit(len(rounds))))
        todo = done.where("_clean.kept").select("_row", F.col("_clean.text").alias("text"))
        if todo.isEmpty():
            break
    every = rounds[0]
    for more in rounds[1:]:
        every = every.union(more)
    last = every.groupBy("_row").agg(F.max_by("_clean", "_round").alias("_clean"))
    return base.join(last, "_row", "left")
