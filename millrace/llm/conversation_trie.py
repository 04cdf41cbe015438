"""The trie of all prefixes of conversations, by a z-fast trie.

A conversation is a sequence of turns; a node is a distinct sequence of first turns. Only hashes
of prefixes (128 bits, from the MD5 of each turn) and the turns' sizes travel, never texts.

1. Equal conversations are one sequence with a count; the digest of their ids is made from
   pieces of bounded size, joined in order.
2. A *batch* of sequences, chosen by hash, forms a compacted trie. Each compacted node is found
   in a dictionary under its handle, the prefix of its extent whose length has the most trailing
   zero bits among the lengths on its edge (the two-fattest); a second dictionary has the first
   prefix of each edge.
3. All sequences look for their *exit node* by fat binary search: a number of probes that grows
   with the logarithm of the length. The first turn beyond the exit names a subtree that no
   sequence of the batch has.
4. While such a subtree has more turns than one task should hold, a *further batch*, twice the
   size, is taken from the sequences in large subtrees and inserted.
5. Each subtree, many of them side by side in a task, is a trie of its own, whose *edges are
   expanded* to nodes; what it adds up to is attached where it left the batches' trie, whose
   edges are expanded last.

Sums over subtrees are differences of running sums in the order in which nodes are met.

Defined results: turns with a null id belong to no conversation; null role or text is empty;
turns of equal rank in a conversation are ordered by their MD5, repeated turns stay; a
conversation without turns is a member of the root only; no conversations give an empty table.
The input is read by its four columns; others are ignored. A conversation is handled as one row
(24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.session import pin

BATCH = 4096  # sequences of the first batch
BATCH_LIMIT = 1 << 18  # sequences of all batches
BATCH_TURNS = 256  # longer sequences are never part of a batch
SUBTREE_TURNS = 1 << 19  # of one subtree in one task
TASK_TURNS = 1 << 16  # handled at once, where subtrees are smaller
IDS = 256  # ids in a piece that is digested

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SEQUENCE = "conv_id long, n int, h1 array<long>, h2 array<long>, bytes array<long>"
END = "f1 long, f2 long, n int, conv_id long, members long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_key, bytes)``: places of turns from 1 on, MD5 of role and text, and
    the text's size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", key.alias("turn_key"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "turn_key", "bytes")


def _prefix_hashes(keys: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every prefix of sequences that lie end to end; ``keys``: 16 bytes each as two numbers."""
    place = (np.arange(len(keys)) - np.repeat(cuts[:-1], np.diff(cuts))).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in (0, 1):
            h = W.mixed(W.combined(keys[:, k], keys[:, 1 - k]) + place * np.uint64(0x9E3779B97F4A7C15))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
            out.append(W.mixed(total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))))
    return out[0], out[1]


def sequences(turns: DataFrame, members: DataFrame) -> DataFrame:
    """``SEQUENCE`` rows of all conversations in ``members (conv_id)``, distinct, from
    ``turns (conv_id, pos, turn_key, bytes)`` in the order of ``pos``."""
    turn = F.struct("pos", "turn_key", "bytes")
    rows = turns.select("conv_id", turn.alias("turn")).union(members.select("conv_id", F.lit(None).cast("struct<pos:int,turn_key:binary,bytes:bigint>")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            values = pc.list_flatten(lists)
            data = b"".join(values.field(1).to_pylist())
            h1, h2 = _prefix_hashes(np.frombuffer(data, np.uint64).reshape(-1, 2), cuts)
            at = pa.array(cuts, pa.int32())
            arrays = [pa.ListArray.from_arrays(at, x) for x in (pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), values.field(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *arrays], names=["conv_id", "n", "h1", "h2", "bytes"])

    return whole.mapInArrow(run, SEQUENCE)


def distinct_sequences(found: DataFrame) -> DataFrame:
    """``SEQUENCE`` rows of the least conversation of each distinct sequence, with the number of its
    ``members`` and the digest of their ids, ascending and joined by commas."""
    last = [F.when(F.col("n") > 0, F.element_at(h, -1)).otherwise(F.lit(0)).alias(f) for f, h in (("f1", "h1"), ("f2", "h2"))]
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    pieces = (
        found.select(*last, "n", "conv_id", F.floor(F.col("conv_id") / IDS).alias("piece"))
        .groupBy("f1", "f2", "n", "piece")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), ids.alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece after another, so a sequence with many members takes no memory.
        now, sha, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["f1"], row["f2"], row["n"])
                if key != now:
                    if now is not None:
                        out.append((*now, first, members, sha.hexdigest()))
                    now, first, members, sha = key, row["conv_id"], 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row["ids"].encode())
                members += row["members"]
            yield _ends(out)
            out = []
        if now is not None:
            yield _ends([(*now, first, members, sha.hexdigest())])

    ends = pieces.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "n", "piece").mapInArrow(digest, END)
    return found.join(ends.select("conv_id", "members", "ends_sha256"), "conv_id")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["f1", "f2", "n", "conv_id", "members", "ends_sha256"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def two_fattest(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number in (low, high] with the most trailing zero bits."""
    differ = (low ^ high).astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        differ |= differ >> np.uint64(s)
    return high & ~(differ >> np.uint64(1)).astype(np.int64)


class ZFastTrie:
    """A compacted trie of distinct sequences (of prefix hashes), and its nodes as positions.

    Sequences stand in the order of their hashes; sequence s owns the nodes of depth
    ``common[s] + 1`` to ``size[s]``, which no sequence before it has. Position 0 is the root,
    the others follow by owner and depth, so that each subtree is a run of positions.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, cuts: np.ndarray):
        order = self._sorted(h1, cuts)
        sizes = np.diff(cuts)[order]
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(cuts[:-1][order] - self.cuts[:-1], sizes) + np.arange(self.cuts[-1])
        self.order, self.size = order, sizes
        self.h1, self.h2 = h1[take], h2[take]
        self.common = np.zeros(len(order), np.int64)
        if len(order) > 1:
            before, now = np.arange(len(order) - 1), np.arange(1, len(order))
            self.common[1:] = self._agreement(before, now, np.minimum(sizes[:-1], sizes[1:]))
        own = self.size - self.common
        self.first = 1 + np.concatenate([[0], np.cumsum(own)])  # position of the first own node
        self.owner = np.concatenate([[-1], np.repeat(np.arange(len(order)), own)])
        self.depth = np.concatenate([[0], np.arange(own.sum()) - np.repeat(self.first[:-1] - 1, own) + np.repeat(self.common, own) + 1])
        self._compact()

    @staticmethod
    def _sorted(h1: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        data = h1.astype(">u8").tobytes()
        text = [data[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return np.array(sorted(range(len(text)), key=text.__getitem__), np.int64)

    def _same(self, s: np.ndarray, t: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Do the sequences s and t, both that long, have the same prefix?"""
        i, j = self.cuts[s] + depth - 1, self.cuts[t] + depth - 1
        return (self.h1[i] == self.h1[j]) & (self.h2[i] == self.h2[j])

    def _agreement(self, s: np.ndarray, t: np.ndarray, limit: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(s), np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (low < high) & self._same(s, t, np.maximum(mid, 1))
            high = np.where((low < high) & ~same, mid - 1, high)
            low = np.where(same, mid, low)
        return low

    def _reach(self, s: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
        """The furthest sequence after (step 1) or before (-1) ``s`` with the same prefix."""
        low, high = np.zeros(len(s), np.int64), len(self.size) - 1 - s if step > 0 else s.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            t = s + step * mid
            same = (low < high) & (self.size[t] >= depth)
            some = np.flatnonzero(same)
            same[some] = self._same(s[some], t[some], depth[some])
            high = np.where((low < high) & ~same, mid - 1, high)
            low = np.where(same, mid, low)
        return s + step * low

    def position(self, s: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Of the node that owner ``s`` has at a depth; 0 for the root."""
        return np.where(depth == 0, 0, self.first[s] + depth - self.common[s] - 1)

    def _compact(self) -> None:
        """Compacted nodes (owner, length, length of the parent's extent) and their dictionaries."""
        s = np.arange(len(self.size))
        fork = np.flatnonzero(self.common > 0)
        owner = self._reach(fork, self.common[fork], -1)
        nodes = np.unique(np.stack([np.concatenate([s, owner]), np.concatenate([self.size, self.common[fork]])], axis=1), axis=0)
        nodes = nodes[nodes[:, 1] > 0]
        self.node_owner, self.node_size = nodes[:, 0], nodes[:, 1]
        up = self.common[self.node_owner]
        again = np.zeros(len(nodes), bool)
        again[1:] = nodes[1:, 0] == nodes[:-1, 0]
        self.node_up = np.where(again, np.concatenate([[0], nodes[:-1, 1]]) if len(nodes) else up, up)
        self.handles = self._dictionary(two_fattest(self.node_up, self.node_size))
        self.names = self._dictionary(self.node_up + 1)

    def _dictionary(self, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.cuts[self.node_owner] + depth - 1
        order = np.argsort(self.h1[at], kind="stable")
        return self.h1[at][order], self.h2[at][order], order

    @staticmethod
    def _look_up(dictionary: tuple, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        first, second, node = dictionary
        at = W.look_up(h1, first)
        good = at >= 0
        good[good] = second[at[good]] == h2[good]
        return np.where(good, node[np.maximum(at, 0)] if len(node) else -1, -1)

    def locate(self, h1: np.ndarray, h2: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sequences leave the trie: position and depth of the deepest node they share with it."""
        size = np.diff(cuts)
        low, high, node = np.zeros(len(size), np.int64), size.copy(), np.full(len(size), -1, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_) or not len(self.node_size):
                break
            f = two_fattest(low[open_], high[open_])
            at = cuts[open_] + f - 1
            found = self._look_up(self.handles, h1[at], h2[at])
            hit = found >= 0
            node[open_[hit]] = found[hit]
            low[open_[hit]] = self.node_size[found[hit]]
            high[open_[~hit]] = f[~hit] - 1
        # Past the whole extent: the edge below may share a few turns, less than its handle.
        extent = np.where(node >= 0, self.node_size[node] if len(self.node_size) else 0, 0)
        below = np.flatnonzero(extent < size)
        whole = extent[below] == 0
        inner = below[~whole]
        tip = self.cuts[self.node_owner[node[inner]]] + extent[inner] - 1
        at = cuts[inner] + extent[inner] - 1
        whole[~whole] = (self.h1[tip] == h1[at]) & (self.h2[tip] == h2[at])
        below = below[whole]
        if len(below) and len(self.node_size):
            at = cuts[below] + extent[below]
            child = self._look_up(self.names, h1[at], h2[at])
            node[below] = np.where(child >= 0, child, node[below])
        depth = np.zeros(len(size), np.int64)
        inside = np.flatnonzero(node >= 0)
        if len(inside):
            owner = self.node_owner[node[inside]]
            a, b = np.zeros(len(inside), np.int64), np.minimum(self.node_size[node[inside]], size[inside])
            while (a < b).any():
                mid = (a + b + 1) >> 1
                i, j = self.cuts[owner] + np.maximum(mid, 1) - 1, cuts[inside] + np.maximum(mid, 1) - 1
                same = (a < b) & (self.h1[i] == h1[j]) & (self.h2[i] == h2[j])
                b = np.where((a < b) & ~same, mid - 1, b)
                a = np.where(same, mid, a)
            depth[inside] = a
        out = np.zeros(len(size), np.int64)
        out[inside] = self.position(self.node_owner[node[inside]], depth[inside])
        return out, depth

    def parents(self) -> np.ndarray:
        """Position of each position's parent; -1 for the root."""
        out = np.arange(-1, len(self.depth) - 1)
        s = np.arange(len(self.size))
        s = s[self.size > self.common]
        flat = self.common[s] == 0
        out[self.first[s[flat]]] = 0
        s = s[~flat]
        out[self.first[s]] = self.position(self._reach(s, self.common[s], -1), self.common[s])
        return out

    def expand(self, values: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, np.ndarray]:
        """All nodes with sums over their subtrees. ``values``: by position, ``members`` that end
        there or below and outside this trie, their ``least`` id, and ``children``, ``leaves`` and
        ``saved`` tokens outside; ``sizes``: bytes of the last text of each position."""
        n = len(self.depth)
        end = np.full(n, n)
        if n > 1:
            end[1:] = self.first[self._reach(self.owner[1:], self.depth[1:], 1) + 1]
        at = np.arange(n)

        def subtree(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[end] - total[at]

        parent = self.parents()
        children = np.bincount(parent[1:], minlength=n) + values["children"]
        members = subtree(values["members"])
        return {
            "depth": self.depth,
            "parent": parent,
            "members": members,
            "least": _least(values["least"], at, end),
            "children": children,
            "leaves": subtree((children == 0) + values["leaves"]),
            "saved": subtree((members - 1) * sizes + values["saved"]),
        }


def _least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum over each range, from minima over ranges of powers of two."""
    out, level, width = np.full(len(x), np.iinfo(np.int64).max), x, 1
    span = high - low
    while True:
        here = np.flatnonzero((span >= width) & (span < 2 * width))
        out[here] = np.minimum(level[low[here]], level[high[here] - width])
        if 2 * width > len(x):
            return out
        level, width = np.minimum(level[:-width], level[width:]), 2 * width


class _Rows:
    """A batch of sequences as arrays, without each one's first turns (``skip``)."""

    def __init__(self, batch: pa.RecordBatch, skip: np.ndarray | None = None):
        sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "bytes")]
        if skip is not None:
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            keep = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes) >= np.repeat(skip, sizes)
            flat, sizes = [x[keep] for x in flat], sizes - skip
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.h1, self.h2 = (x.view(np.uint64) for x in flat[:2])
        self.bytes = flat[2]


def _last_bytes(trie: ZFastTrie, rows: _Rows) -> np.ndarray:
    """Bytes of the last text of each position."""
    s = trie.order[trie.owner[1:]]
    return np.concatenate([[0], rows.bytes[rows.cuts[s] + trie.depth[1:] - 1]])


def _zeros(trie: ZFastTrie) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(trie.depth), np.int64) for k in ("members", "children", "leaves", "saved")}
    return out | {"least": np.full(len(trie.depth), np.iinfo(np.int64).max)}


def _expanded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of the subtrees of located sequences; ``at`` is the position of a subtree's parent."""
    skip = batch.column("depth").to_numpy(zero_copy_only=False)
    rows = _Rows(batch, skip)
    trie = ZFastTrie(rows.h1, rows.h2, rows.cuts)
    values = _zeros(trie)
    ends = trie.position(np.arange(len(trie.size)), trie.size)
    values["members"][ends] = batch.column("members").to_numpy(zero_copy_only=False)[trie.order]
    values["least"][ends] = batch.column("conv_id").to_numpy(zero_copy_only=False)[trie.order]
    found = trie.expand(values, _last_bytes(trie, rows))
    top = found["depth"] == 1
    of = trie.order[trie.owner[1:]]
    at = batch.column("at").to_numpy(zero_copy_only=False)
    digests = np.full(len(trie.depth), NO_ENDS, object)
    digests[ends] = np.array(batch.column("ends_sha256").to_pylist(), object)[trie.order]
    columns = [
        pa.array(at[of], mask=~top[1:]),
        pa.array(found["least"][1:]),
        pa.array(found["depth"][1:] + skip[of]),
        pa.array(found["least"][found["parent"][1:]], mask=top[1:]),
        *[pa.array(found[c][1:]) for c in ("members", "children", "leaves", "saved")],
        pa.array(digests[1:], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["at", *_names(NODE)])


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _first_batches(found: DataFrame, batch: int, subtree_turns: int) -> tuple[ZFastTrie, _Rows]:
    """The trie of the batches: inserted until no subtree outside it is too large for a task."""
    chosen = found.where((F.col("n") > 0) & (F.col("n") <= BATCH_TURNS)).select("n", "h1", "h2", "bytes")
    order = F.xxhash64(F.element_at("h1", -1), F.element_at("h2", -1))
    table = chosen.orderBy(order).limit(batch).toArrow()
    while True:
        rows = _Rows(table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema))
        trie = ZFastTrie(rows.h1, rows.h2, rows.cuts)
        left = _located(found, trie).where("n > depth")
        sizes = left.groupBy("k1", "k2").agg(F.sum(F.col("n") - F.col("depth")).alias("turns"), F.count("*").alias("sequences"))
        large = pin(sizes.where((F.col("turns") > subtree_turns) & (F.col("sequences") > 1)).select("k1", "k2"), "large-subtrees")
        more = min(table.num_rows * 2, BATCH_LIMIT - table.num_rows)
        if more <= 0:
            return trie, rows
        wanted = left.where(F.col("n") <= BATCH_TURNS).join(large, ["k1", "k2"], "left_semi").select("n", "h1", "h2", "bytes")
        added = wanted.orderBy(order).limit(more).toArrow()
        if not added.num_rows:
            return trie, rows
        table = pa.concat_tables([table, added])


def _located(found: DataFrame, trie: ZFastTrie) -> DataFrame:
    """``found`` with the position and depth of each sequence's exit, and the hashes of its first
    prefix beyond it (null: it ends within the trie)."""
    schema = T.StructType(
        [*found.schema.fields, *[T.StructField(c, T.LongType()) for c in ("at", "depth", "k1", "k2")]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch)
            at, depth = trie.locate(rows.h1, rows.h2, rows.cuts)
            ended = depth == np.diff(rows.cuts)
            place = np.where(ended, 0, rows.cuts[:-1] + depth)
            keys = [np.append(h, np.uint64(0))[place].view(np.int64) for h in (rows.h1, rows.h2)]
            new = [pa.array(at), pa.array(depth), *[pa.array(k, mask=ended) for k in keys]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return found.mapInArrow(run, schema)


def prefix_trie(found: DataFrame, batch: int = BATCH, subtree_turns: int = SUBTREE_TURNS) -> DataFrame:
    """``NODE`` rows of the sequences of ``distinct_sequences``."""
    trie, rows = _first_batches(found, batch, subtree_turns)
    located = _located(found, trie)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = lambda x: pc.subtract(x.column("n").cast(pa.int64()), x.column("depth"))
        for group in W.whole_groups(batches, ("k1", "k2"), turns, TASK_TURNS):
            yield _expanded(group)

    outside = located.where("n > depth").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    below = pin(outside.mapInArrow(expand, "at long, " + NODE), "subtrees")
    ended = located.where("n = depth").select(
        "at", F.col("members").alias("n_convs"), "conv_id", F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("tops"), "ends_sha256"
    )
    tops = below.where("at IS NOT NULL").select(
        "at", "n_convs", "conv_id", "n_leaves", "saved_tokens", F.lit(1).alias("tops"), F.lit(None).cast("string")
    )
    # As many rows as the batches' trie has nodes, at most.
    attached = ended.union(tops).groupBy("at").agg(
        F.sum("n_convs").alias("members"),
        F.min("conv_id").alias("least"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"),
        F.sum("tops").alias("children"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    sizes = _last_bytes(trie, rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        at = table.column("at").to_numpy(zero_copy_only=False)
        values = _zeros(trie)
        for name in values:
            values[name][at] = table.column(name).to_numpy(zero_copy_only=False)
        found = trie.expand(values, sizes)
        digests = np.full(len(trie.depth), NO_ENDS, object)
        has = np.flatnonzero(pc.is_valid(table.column("ends_sha256")).to_numpy(zero_copy_only=False))
        digests[at[has]] = np.array(table.column("ends_sha256").to_pylist(), object)[has]
        up = np.maximum(found["parent"], 0)
        columns = [
            pa.array(np.arange(len(digests))),
            pa.array(found["least"]),
            pa.array(found["depth"]),
            pa.array(found["least"][up], mask=found["parent"] < 0),
            *[pa.array(found[c]) for c in ("members", "children", "leaves", "saved")],
            pa.array(digests, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["pos", *_names(NODE)])

    inner = pin(attached.repartition(1).mapInArrow(finish, "pos long, " + NODE), "batch-nodes")
    parent = inner.select(F.col("pos").alias("at"), F.col("conv_id").alias("above"))
    filled = below.join(parent, "at", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return inner.select(*_names(NODE)).union(filled.select(*_names(NODE)))


def trie_of(turns: DataFrame, members: DataFrame, batch: int = BATCH, subtree_turns: int = SUBTREE_TURNS) -> DataFrame:
    """``NODE`` rows of the conversations ``members (conv_id)`` with the turns
    ``turns (conv_id, pos, turn_key, bytes)``."""
    found = pin(sequences(turns, members), "conversations")
    return prefix_trie(pin(distinct_sequences(found), "distinct-conversations"), batch, subtree_turns)
