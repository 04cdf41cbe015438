"""SimHash near-duplicates with pigeonring filtering.

The fingerprint has a bit set where over half of the 64-bit hashes of a document's
word shingles have it. Rows of one fingerprint are one node from then on, so a group
of copies costs as much as one document.

Fingerprints are cut into ``SEGMENTS`` segments on a ring. If two of them differ in
at most ``BITS`` bits, then from some segment on, the differences in the first l
segments are at most ``l * BITS / SEGMENTS`` for every l (the pigeonring principle).
While that budget is below one the segments are equal; they are the join key. The
later, larger budgets prune the candidates, then the full distance decides.

A key that more than ``PAIR_LIMIT`` fingerprints share does not emit their pairs. Two
fingerprints within two bits have a common one within one bit of both, so each member
names everything within one bit of itself (outside the equal key) and is linked to
the least other member that names the same; such a group has no more members than
bits, all of them within two bits of each other. That reaches the same components.

Defined results: null and empty texts have fingerprint 0, linked like any other; a
text of fewer words than a shingle is one shingle; equal ids count once for the
smallest id, and each row is returned; a null id takes the component of its
fingerprint, null only if no linked row has an id; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.components import components
from millrace.session import pin

SHINGLE = 3
SEED = 42
BITS = 2
SEGMENTS = 16
PAIR_LIMIT = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    cut, digest = joined.__getitem__, xxhash.xxh64_intdigest
    spans = map(slice, starts[:n].tolist(), ends[-n:].tolist())
    return folded(np.fromiter((digest(cut(s), SEED) for s in spans), np.uint64, n))


def folded(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


_LOWER = bytes(W.LOWER.tolist())


def with_fingerprints(
    docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp"
) -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    def make():
        def work(texts: pa.Array) -> list:
            values = [fingerprint(t.as_py(), shingle) for t in texts]
            return [pa.array(np.array(values, np.uint64).view(np.int64))]

        return work

    return W.with_text_columns(docs, text_col, [T.StructField(name, T.LongType())], make)


def _turned(fp: Column, left: int) -> Column:
    if left == 0:
        return fp
    return F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def chain_budgets(bits: int, segments: int) -> list[tuple[int, int]]:
    """``(length, budget)``: chains of ``length`` segments may differ in
    ``budget`` bits. Of equal budgets only the longest chain is listed."""
    budgets = [(n, n * bits // segments) for n in range(1, segments + 1)]
    return [x for x, after in zip(budgets, [*budgets[1:], (0, -1)]) if x[1] != after[1]]


def within_chain(a: Column, b: Column, bits: int, segments: int) -> Column:
    """Do two turned fingerprints keep every budget of the chain, the last one
    being the full distance?"""
    width = 64 // segments
    tests = []
    for n, budget in chain_budgets(bits, segments):
        differing = a.bitwiseXOR(b)
        tests.append(F.bit_count(F.shiftrightunsigned(differing, 64 - n * width)) <= budget if n < segments else F.bit_count(differing) <= budget)
    return reduce(lambda x, y: x & y, tests)


def links(fps: DataFrame, segments: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` among the distinct fingerprints of a written table
    ``fps (fp)`` that join all fingerprints reachable over steps of two bits."""
    bits = BITS
    width = 64 // segments
    equal = -(-segments // bits) - 1
    low = 64 - equal * width  # bits outside the key
    turns = F.posexplode(F.array(*[_turned(F.col("fp"), i * width) for i in range(segments)])).alias("turn", "f")
    turned = fps.select(turns).withColumn("key", F.shiftrightunsigned("f", low))
    buckets = pin(
        turned.groupBy("turn", "key")
        .agg(F.count("*").alias("n"), F.min("f").alias("f"), F.max("f").alias("g"))
        .where("n > 1"),
        "buckets",
    )
    two = buckets.where("n = 2").where(within_chain(F.col("f"), F.col("g"), bits, segments)).select("turn", "f", "g")
    members = pin(turned.join(buckets.where("n > 2").select("turn", "key", "n"), ["turn", "key"]), "members")
    few = members.where(F.col("n") <= pair_limit).drop("n")
    others = few.select("turn", "key", F.col("f").alias("g"))
    pairs = (
        few.join(others, ["turn", "key"])
        .where(F.col("f") < F.col("g"))
        .where(within_chain(F.col("f"), F.col("g"), bits, segments))
        .select("turn", "f", "g")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(low)])
    meeting = (
        members.where(F.col("n") > pair_limit)
        .select("turn", "f", F.explode(flips).alias("flip"))
        .select("turn", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("middle"))
        .groupBy("turn", "middle")
        .agg(F.collect_list("f").alias("all"))
        .where(F.size("all") > 1)
        .select("turn", F.array_min("all").alias("f"), F.explode("all").alias("g"))
        .where("f != g")
    )

    def restored(c: str) -> Column:
        return F.element_at(
            F.array(*[_turned(F.col(c), (64 - i * width) % 64) for i in range(segments)]), F.col("turn") + 1
        )

    return two.union(pairs).union(meeting).select(restored("f").alias("a"), restored("g").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: id, ``fp`` (long), ``component_id``."""
    rows = pin(with_fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fp"), "fingerprints")
    return labelled(rows, id_col).drop("class")


def labelled(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (of a written table with ``fp``) with ``class``, a number of the
    component, and ``component_id``."""
    fps = pin(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(links(fps.select("fp"))).withColumnsRenamed({"node": "fp", "root": "_root"})
    rooted = fps.join(roots, "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    best = rooted.groupBy("_root").agg(F.min("least").alias("component_id"))
    named = pin(rooted.join(best, "_root").select("fp", F.col("_root").alias("class"), "component_id"), "classes")
    # One fingerprint may own most rows; the adaptive planner splits it here.
    return rows.join(named, "fp", "left")
