import random

import helpers as H
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components as C
from millrace.llm import simhash as S


def slow_fingerprint(text):
    w = H.blanks(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if n[b] * 2 > len(shingles))


def slow_components(fps):
    """Smallest id reachable, by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    got = S.with_fingerprints(H.documents(spark)).select("doc_id", "text", "fp").collect()
    assert all(r["fp"] == signed(slow_fingerprint(r["text"])) for r in got)


def test_components_against_all_pairs(spark):
    """Random fingerprints with clouds around some: small, and far above the pair limit."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for size, spread in ((200, 2), (60, 3), (20, 4)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, spread + 1))))
    fps |= {0, 3, 1 << 63, (1 << 63) | 5, (1 << 64) - 1}
    rows = [(i, signed(f)) for i, f in enumerate(sorted(fps, key=lambda f: f * 7919 % 10007))] * 2
    rows += [(None, rows[5][1])]
    table = spark.createDataFrame(rows, "doc_id long, fp long").repartition(4)
    for limit in (S.PAIR_LIMIT, 2):
        edges = S.links(table.select("fp").distinct(), pair_limit=limit)
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges.collect())
    want = slow_components(fps)
    least = {}
    for i, f in rows:
        if i is not None:
            r = want[f % 2**64]
            least[r] = min(least.get(r, i), i)
    for r in S.labelled(table, "doc_id").collect():
        assert r["component_id"] == least[want[r["fp"] % 2**64]]


def test_awkward_rows_and_empty_tables(spark):
    out = S.near_duplicates(H.documents(spark)).collect()
    assert len(out) == len(H.rows())
    zero = {r["component_id"] for r in out if r["fp"] == 0}
    assert zero == {100}
    assert S.near_duplicates(H.nothing(spark)).collect() == []


def test_chains_are_the_pigeonring_budgets():
    assert S.chain_budgets(2, 16) == [(7, 0), (15, 1), (16, 2)]
    assert S.chain_budgets(3, 8) == [(2, 0), (5, 1), (7, 2), (8, 3)]


def test_component_search_on_chains_and_hubs(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (2, 1), (None, 3)]
    got = dict(C.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, n + 1)} | {k: 1000 for k in range(1001, 1400)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert C.components(spark.createDataFrame(edges, "a long, b long")).where(F.col("node") == F.col("root")).count() == 0
