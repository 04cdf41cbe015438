"""Embedding near-duplicates with a forest of random-projection trees.

A tree splits recursively: at each level a random direction, at each node a
threshold, the median of a sample's projections there. Vectors near a threshold go to both
sides, so that close pairs rarely part: within ``SPILL`` standard deviations of the
projected difference of a pair at the limit. ``TREES`` trees catch what one misses. Rows of one label in one leaf are compared by a matrix product in
double precision. A pair that meets in several leaves counts in the first one only,
which both rows know from the list of leaves they carry, so no pair is ever emitted or
deduplicated: a leaf returns link counts per row and a spanning forest of its links.

Rows of one label with the same vector are one node, weighted by their number. A group
above ``GROUP_ROWS`` rows is cut into blocks, and the pairs of blocks are compared in
tasks of their own: exact, at the price of repeating the rows.

A split whose margin holds a large share of a node's rows would send most of them both ways. So
the rows' expected number of copies is tracked down every path, and a node at which it would
pass ``MAX_GROWTH`` is not split there: in a dense cloud leaves grow instead of copies, and large
leaves are compared block by block.

The trees are fitted on at most ``SAMPLE_ROWS`` distinct vectors (the smallest by hash);
every vector is indexed. What is sent to the executors is bounded by ``TREES`` and
``MAX_DEPTH`` alone.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing and are their own component; vectors of
different length never link; equal ids are separate vectors under one name; an empty
table gives an empty table. Columns are chosen by name; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.session import pin

COSINE = 0.98
TREES = 5
SPILL = 0.5
LEAF_ROWS = 512
GROUP_ROWS = 2048
MAX_DEPTH = 18
SAMPLE_ROWS = 50_000
LEAST_SPLIT = 16
MAX_GROWTH = 4.0  # copies of a row in a tree, on average over the rows of a leaf
SEED = 7


def usable(vector: Column, label: Column) -> Column:
    """Can this row link with anything?"""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spill(cosine: float, dimensions: int) -> float:
    """Distance from a threshold up to which a vector goes to both sides."""
    return SPILL * float(np.sqrt(2 * (1 - cosine) / dimensions))


class Forest:
    """Directions by (tree, level) and thresholds by (tree, level, node); infinite where a node
    is not split."""

    def __init__(
        self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED, margin: float = 0.0, growth: float = MAX_GROWTH
    ):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        directions = rng.standard_normal((trees, depth, sample.shape[1]))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.thresholds = [[np.zeros(1 << level) for level in range(depth)] for _ in range(trees)]
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            centre = np.zeros((1, sample.shape[1]))
            holder = np.zeros(1, np.int64)  # whose centre a node too small to split goes by
            share, copies = np.zeros(1), np.ones(1)  # of rows in the margin (as last seen); of a row so far
            for level in range(depth):
                side = sample @ self.directions[t, level]
                order = np.lexsort((side, node))
                bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
                size = np.diff(bounds)
                large = np.flatnonzero(size >= LEAST_SPLIT)
                if len(large):
                    means = np.stack([sample[order[bounds[k] : bounds[k + 1]]].mean(axis=0) for k in large])
                    holder = holder.copy()
                    holder[large] = len(centre) + np.arange(len(large))
                    centre = np.concatenate([centre, means])
                cut = centre[holder] @ self.directions[t, level]
                cut[large] = side[order[bounds[large] + size[large] // 2]]
                near = np.bincount(node[np.abs(side - cut[node]) < margin], minlength=1 << level)
                share = np.where(size >= LEAST_SPLIT, near / np.maximum(size, 1), share)
                split = copies * (1 + share) <= growth
                cut[~split] = np.inf
                copies = np.where(split, copies * (1 + share), copies)
                self.thresholds[t][level] = cut
                node = node * 2 + (side >= cut[node])
                holder, share, copies = (np.repeat(x, 2) for x in (holder, share, copies))

    def leaves(self, vectors: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the numbers of the leaves they fall in, in order of rows."""
        rows, codes = [], []
        for t in range(self.trees):
            row = np.arange(len(vectors))
            node = np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                off = (vectors @ self.directions[t, level])[row] - self.thresholds[t][level][node]
                left, right = off < margin, off >= -margin
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows.append(row)
            codes.append((t << self.depth) + node)
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths)


def _indexed(nodes: DataFrame, shared, cosine: float) -> DataFrame:
    """One row for each node and leaf, with the list of all the node's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                vectors = unit(_matrix(part.column(2)))
                row, code = forest.leaves(vectors, spill(cosine, vectors.shape[1]))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                all_leaves = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code, pa.int64()))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(code, pa.int64()), all_leaves.take(pa.array(row))],
                    names=["rep", "label", "v", "weight", "leaf", "leaves"],
                )

    kind = nodes.schema["v"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("rep", "label", "v", "weight").mapInArrow(
        run, f"rep long, label {label}, v {kind}, weight long, leaf long, leaves array<long>"
    )


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """Link counts and a spanning forest of one group (or pair of blocks)."""
    table = table.combine_chunks()
    leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
    vectors = unit(_matrix(table.column("v").combine_chunks()))
    reps = table.column("rep").to_numpy()
    weights = table.column("weight").to_numpy()
    leaves = table.column("leaves").to_pylist()
    block = table.column("block").to_numpy()
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    counts = np.zeros(len(reps), np.int64)
    parent = list(range(len(reps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    alone = np.array([x[0] == leaf for x in leaves])  # nothing can meet before its first leaf
    sets = [frozenset(x) for x in leaves]
    for at in range(0, len(first), 512):
        a = first[at : at + 512]
        close = vectors[a] @ vectors[second].T >= cosine
        for x, hits in zip(a.tolist(), close):
            y = second[hits]
            if i == j:
                y = y[y > x]
            if not alone[x]:
                y = np.array([k for k in y.tolist() if alone[k] or min(sets[x] & sets[k]) == leaf], np.int64)
            if len(y):
                counts[x] += weights[y].sum()
                counts[y] += weights[x]
                for k in y.tolist():
                    p, q = find(x), find(k)
                    if p != q:
                        parent[p] = q
    hit = np.flatnonzero(counts)
    root = [int(reps[find(k)]) for k in hit.tolist()]
    return pa.table({"rep": reps[hit], "other": pa.array(root, pa.int64()), "links": counts[hit]})


def linked(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(rep, other, links)``: of a written table of nodes (rep, label, v, weight) of
    one vector length, partial link counts and edges that span their components."""
    spark = nodes.sparkSession
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, largest) / LEAF_ROWS)))))
    sample = nodes.orderBy(F.xxhash64("rep", "v")).limit(SAMPLE_ROWS).select("v").toArrow()
    fitted = unit(_matrix(sample.column(0).combine_chunks()))
    forest = Forest(fitted, depth, margin=spill(cosine, fitted.shape[1]))
    indexed = _indexed(nodes, spark.sparkContext.broadcast(forest), cosine)
    large = (
        indexed.groupBy("leaf", "label")
        .count()
        .where(F.col("count") > GROUP_ROWS)
        .select("leaf", "label", F.ceil(F.col("count") * 2 / GROUP_ROWS).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    both = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    placed = (
        indexed.join(pin(large, "large-leaves"), ["leaf", "label"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("pair", F.explode(both))
        .select("rep", "label", "v", "weight", "leaf", "leaves", "block", "pair.i", "pair.j")
    )
    return placed.groupBy("leaf", "label", "i", "j").applyInArrow(
        lambda table: _compare(table, cosine), "rep long, other long, links long"
    )


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("_ok", usable(F.col("v"), F.col("label")))
    digest = [F.xxhash64(F.lit(s), "label", F.size("v"), "v").alias(f"_k{s}") for s in (1, 2)]
    good = rows.where("_ok").select("_id", "label", "v", *digest)
    nodes = pin(
        good.groupBy("_k1", "_k2").agg(
            F.min("_id").alias("least"), F.count("*").alias("weight"), F.min(F.struct("label", "v")).alias("_x")
        ).select("_k1", "_k2", "least", "weight", "_x.label", "_x.v", F.col("_k1").alias("rep")),
        "vectors",
    )
    lengths = [r[0] for r in nodes.select(F.size("v").alias("n")).distinct().collect()]
    found = None
    for n in sorted(lengths):
        part = linked(nodes.where(F.size("v") == n), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "rep long, other long, links long")
    found = pin(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    rooted = (
        nodes.join(counts, "rep", "left")
        .join(roots.withColumnsRenamed({"node": "rep", "root": "_root"}), "rep", "left")
        .withColumn("_root", F.coalesce("_root", "rep"))
    )
    best = rooted.groupBy("_root").agg(F.min("least").alias("component_id"))
    named = pin(
        rooted.join(best, "_root").select(
            "_k1", "_k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
        ),
        "vector-classes",
    )
    joined = good.select("_id", "_k1", "_k2").join(named, ["_k1", "_k2"]).select("_id", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("_id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
