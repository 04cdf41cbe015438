"""Near copies by the overlap of word shingles: SimHash and min-hash candidates, exact comparison.

A document is the set of its shingles of ``SHINGLE`` words (between ASCII blanks, A-Z
lower-cased); a text of fewer words is one shingle. Documents of equal sets are one node.
Nodes that may be alike are compared by their whole sets; those of ``SIMILARITY`` or more
are linked, and of each component of links one document stays.

Candidates come in two ways. SimHash fingerprints of the sets within two bits, found by
pigeonring filtering (``simhash``), join what is all but equal. That is far from reaching
0.8, where 64-bit fingerprints differ in ten bits on average, so min-hashes complete it:
``BANDS`` hashes, each of ``ROWS`` minima over the set, bring nodes together; a pair of
similarity s meets with a probability of 1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8.

A hash that at most ``PAIR_LIMIT`` nodes share gives their pairs. One that more share gives
none: first each node is compared with the least one, then, as long as the nodes are not one
component, all nodes outside the largest component with all nodes of other components,
block by block in tasks of their own, a pair under the first hash it shares. So every pair
that shares a hash is compared or already linked.

Defined results: texts without words are one node; equal ids count once for the
smallest id; null ids come last; columns are named apart from the caller's, which come back
as they were; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import simhash
from millrace.llm import words as W
from millrace.llm.components import components
from millrace.session import pin

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8
BANDS = 20
ROWS = 5
PAIR_LIMIT = 32
BLOCK = 256  # nodes, and
BLOCK_HASHES = 1 << 20  # shingles of a block, on average
CHUNK = 4096  # shingles at once

_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    data, offsets = W.flat(texts)
    data = W.LOWER[data]
    starts, ends, bounds = W.places(data, offsets, W.BLANK_WORD)
    h = W.hashes(data, starts, ends)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = min(shingle, b - a)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        keys = h[a : b - n + 1]
        for k in range(1, n):
            keys = W.combined(keys, h[a + k : b - n + 1 + k])
        out.append(np.unique(keys))
    return out


def _bands(keys: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(keys), CHUNK):
            np.minimum(least, (keys[i : i + CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = W.combined(out, column)
    return out.view(np.int64)


def _nodes(keys: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(W.mixed(keys).sum(dtype=np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _sets(texts: DataFrame) -> DataFrame:
    """``(node, set)`` of ``texts (node, text)``."""
    W.bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = shingle_sets(part.column(1))
                cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                hashes = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cuts, hashes)], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    first, second = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")) for c in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(run, "a long, b long")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that join all nodes whose fingerprints are linked by steps of two bits."""
    fps = pin(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    of = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    near = simhash.links(fps.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = nodes.join(fps, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return near.union(equal)


def _components(links: DataFrame) -> DataFrame:
    return pin(components(links), "components")


def _in_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of hashes that more than one component shares, with their component ``comp``."""
    rows = members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_ = rows.groupBy("band", "key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low != _high")
    return pin(rows.join(open_.select("band", "key"), ["band", "key"], "left_semi"), "open-members")


def _blocks(n, hashes):
    """How many blocks so many nodes with so many shingles make."""
    return F.ceil(F.greatest(n / F.lit(BLOCK), hashes / F.lit(BLOCK_HASHES))).cast("int")


def _spread(blocks):
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _with_least(members: DataFrame) -> DataFrame:
    """Tasks ``(band, key, i, j)`` in which the least node of a hash (``side`` 0) meets a block of those
    that have it as the first of their large ones; each node is its own component yet."""
    stats = members.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("hashes"))
    stats = pin(stats.withColumn("parts", _blocks(F.col("n"), F.col("hashes"))), "large-buckets")
    hub = stats.select("band", "key", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    first = members.groupBy("node").agg(F.min(F.struct("band", "key")).alias("at")).select("node", "at.band", "at.key")
    met = first.join(stats, ["band", "key"]).where("node != hub").withColumn("j", _spread(F.col("parts")))
    columns = ["band", "key", F.lit(0).alias("i"), "j", "node", F.col("node").alias("comp")]
    return hub.select(*columns, F.lit(0).alias("side")).union(met.select(*columns, F.lit(1).alias("side")))


def _with_others(members: DataFrame) -> DataFrame:
    """Tasks ``(band, key, i, j)`` in which a block of nodes outside the largest component of a hash
    (``side`` 0) meets a block of all its nodes."""
    comps = members.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    most = F.max(F.struct("n", "comp"))
    stats = comps.groupBy("band", "key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    rest = comps.join(stats.select("band", "key", "most"), ["band", "key"]).where("comp != most.comp")
    rest = rest.groupBy("band", "key").agg(F.sum("n").alias("rest_n"), F.sum("hashes").alias("rest_hashes"))
    stats = stats.join(rest, ["band", "key"]).withColumn("rows", _blocks(F.col("rest_n"), F.col("rest_hashes")))
    stats = pin(stats.withColumn("parts", _blocks(F.col("n"), F.col("hashes"))), "open-buckets")
    placed = members.join(stats, ["band", "key"])
    few = placed.where("comp != most.comp").withColumn("i", _spread(F.col("rows"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_ = placed.withColumn("j", _spread(F.col("parts"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    columns = ["band", "key", "i", "j", "node", "comp"]
    return few.select(*columns, F.lit(0).alias("side")).union(all_.select(*columns, F.lit(1).alias("side")))


def _linked(rows: pa.RecordBatch, once: bool) -> list[tuple[int, int]]:
    """Links between nodes of the two sides of a task, as many as it takes to join their
    components. ``once``: only pairs that have this hash as the first in common."""
    side = rows.column("side").to_numpy()
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(x) or not len(y):
        return []
    node, comp = (rows.column(c).to_numpy() for c in ("node", "comp"))
    bands = rows.column("bands").flatten().to_numpy().reshape(-1, BANDS)
    band = rows.column("band")[0].as_py()
    sets = rows.column("set")
    sizes = pc.list_value_length(sets).to_numpy()
    values = sets.take(pa.array(y)).flatten().to_numpy()
    owner = np.repeat(np.arange(len(y)), sizes[y])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i in x.tolist():
        mine = sets[i].values.to_numpy()
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(y))
        good = (comp[y] != comp[i]) & (both * SIMILARITY[1] >= (sizes[y] + sizes[i] - both) * SIMILARITY[0])
        if once:
            same = bands[y] == bands[i]
            good &= same[:, band] & ~same[:, :band].any(axis=1)
        hit = y[good]
        for c in np.unique(comp[hit]).tolist():
            a, b = find(int(comp[i])), find(c)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[hit[comp[hit] == c][0]])))
    return out


def block_links(tasks: DataFrame, nodes: DataFrame, sets: DataFrame, once: bool) -> DataFrame:
    """Links ``(a, b)`` found in tasks ``(band, key, i, j, node, comp, side)``."""
    keys = ("band", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.whole_groups(batches, keys, lambda rows: pa.array(np.ones(rows.num_rows, np.int64)), 1):
            found = _linked(group, once)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = tasks.join(nodes.select("node", "bands"), "node").join(sets, "node")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between similar nodes that reach all that links between any similar pairs
    reach, of written tables ``nodes (node, fp, size, bands)`` and ``texts (node, text)``."""
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = pin(banded.join(pin(buckets, "buckets"), ["band", "key"]), "members")
    few = members.where(F.col("n") <= PAIR_LIMIT).select("band", "key", F.col("node").alias("a"))
    close = few.join(few.withColumnRenamed("a", "b"), ["band", "key"]).where("a < b").select("a", "b")
    near = simhash_pairs(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pin(close.union(near).distinct(), "candidates")
    large = members.where(F.col("n") > PAIR_LIMIT).select("band", "key", "node", "size")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    sets = pin(_sets(texts.join(wanted, "node", "left_semi")), "candidate-sets")
    found = verified(pairs, sets)
    if large.isEmpty():
        return found
    found = pin(found.union(block_links(_with_least(large), nodes, sets, False)), "links")
    open_ = _in_components(large, _components(found))
    return found if open_.isEmpty() else found.union(block_links(_with_others(open_), nodes, sets, True))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (of several
    such rows any one; null ids last)."""
    row, node, fp, size, bands = (W.fresh(docs, c) for c in ("row", "node", "fp", "size", "bands"))
    fields = [T.StructField(c, T.LongType()) for c in (node, fp, size)] + [T.StructField(bands, T.ArrayType(T.LongType()))]

    def make():
        def work(texts: pa.Array) -> list:
            sets = shingle_sets(texts)
            found = np.concatenate([_bands(x) for x in sets]) if sets else np.zeros(0, np.int64)
            cuts = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
            prints = np.array([simhash.folded(x) for x in sets], np.uint64).view(np.int64)
            sizes = pa.array([len(x) for x in sets], pa.int64())
            return [pa.array([_nodes(x) for x in sets], pa.int64()), pa.array(prints), sizes, pa.ListArray.from_arrays(cuts, pa.array(found))]

        return work

    marked = W.with_text_columns(docs, text_col, fields, make)
    table = pin(marked.withColumn(row, F.monotonically_increasing_id()), "shingled")
    own = table.select(
        *[F.col(f"`{x}`").alias(y) for x, y in ((row, "row"), (node, "node"), (fp, "fp"), (size, "size"), (bands, "bands"), (id_col, "id"), (text_col, "text"))]
    )
    first = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    nodes = pin(own.groupBy("node").agg(F.min("row").alias("row"), *first), "nodes")
    texts = own.select("row", "text").join(nodes.select("node", "row"), "row").select("node", "text")
    roots = components(links(nodes.drop("row"), texts))
    rows = own.select("id", "row", "node").join(roots, "node", "left")
    rows = pin(rows.select("id", "row", F.coalesce("root", "node").alias("class")), "classes")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    least = rows.groupBy("class").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    groups = pin(least.select("class", F.col("least.row").alias("kept")), "groups")
    # Rows to drop are few or many; the planner sees the size of the written table.
    dropped = pin(rows.join(groups, "class").where("row != kept").select(F.col("row").alias(row)), "dropped")
    return table.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
