import helpers as H  # noqa: F401
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep long"


def clouds(seed=0):
    """Close pairs around the limit, large clouds, copies, and rows that cannot link."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    def add(v, label):
        nonlocal n
        rows.append((n, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1))
        n += 1
    for k in range(60):
        centre = rng.standard_normal(16)
        for _ in range(1 + k % 7):
            add(centre + rng.standard_normal(16) * 0.15, int(rng.integers(0, 3)))
    big = rng.standard_normal(16)
    for _ in range(300):
        add(big + rng.standard_normal(16) * 0.1, 0)
    for _ in range(50):
        add(big, 0)
        add(big * 2, 1)
    for v, label in ((None, 0), ([], 0), ([0.0] * 16, 0), ([None] + [1.0] * 15, 0), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] + [1.0] * 15, 1), (big, None), (big[:8], 0), (big[:8], 0), (big * 1e30, 0)):
        add(v, label)
    return rows


def brute(rows, limit=0.98):
    good = {}
    for i, v, label, *_ in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (label, x / np.abs(x).max())
    links = {i: set() for i, *_ in rows}
    keys = sorted(good)
    for a in keys:
        for b in keys:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                    links[a].add(b)
                    links[b].add(a)
    least = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in least:
                least[j] = i
                todo += links[j]
    return sorted((i, len(links[i]), least[i], least[i] == i) for i in links)


def test_one_leaf_is_exact(spark):
    rows = clouds()
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_deep_trees_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF_ROWS", 40)
    monkeypatch.setattr(E, "GROUP_ROWS", 60)
    rows = clouds(1)
    got = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.95 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # nothing below the limit is linked


def test_repeated_ids_and_empty_tables(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 0, "", 0), (1, v, 0, "", 0), (None, v, 0, "", 0)], SCHEMA)
    got = E.near_duplicates(df).select("n_links", "component_id").collect()
    assert [tuple(r) for r in got] == [(2, 1)] * 3
    assert E.near_duplicates(df.limit(0)).collect() == []
    assert E.near_duplicates(df.where("vec_id is null").withColumn("label", F.lit(None).cast("int"))).first()["n_links"] == 0


def test_leaves_do_not_depend_on_batches():
    x = E.unit(np.random.default_rng(0).standard_normal((500, 8)))
    forest = E.Forest(x, 4)
    row, code = forest.leaves(x, 0.05)
    for k in (0, 17, 499):
        assert code[row == k].tolist() == forest.leaves(x[k : k + 1], 0.05)[1].tolist()
    assert set(row.tolist()) == set(range(500))
    assert np.bincount(code >> 4).min() >= 500
    assert forest.leaves(x, 0.0)[0].tolist() == sorted(list(range(500)) * forest.trees)
    assert E.unit(np.array([[1e300, 1e300]])) == pytest.approx(np.array([[0.5**0.5] * 2]))


@pytest.mark.parametrize("depth", [6, 12, 18])
def test_copies_of_a_dense_cloud_are_bounded_and_its_pairs_meet(depth):
    """A cloud in which every pair is near the limit: without a bound each level would send most
    vectors both ways."""
    rng = np.random.default_rng(depth)
    centre = rng.standard_normal(64)
    vectors = E.unit(centre / np.linalg.norm(centre) + rng.standard_normal((3000, 64)) * 0.0155)
    cosines = vectors @ vectors.T
    margin = E.spill(0.98, 64)
    forest = E.Forest(vectors[:1500], depth, margin=margin)
    row, code = forest.leaves(vectors, margin)
    assert len(row) / len(vectors) <= 1.5 * E.TREES * E.MAX_GROWTH
    met = np.zeros((len(vectors), len(vectors)), bool)
    for leaf in np.unique(code):
        members = row[code == leaf]
        met[np.ix_(members, members)] = True
    pairs = np.triu(cosines >= 0.98, 1)
    assert pairs.sum() > 1000 and met[pairs].mean() >= 0.95


def test_a_node_is_split_where_few_rows_are_near_the_border():
    rng = np.random.default_rng(1)
    vectors = E.unit(rng.standard_normal((4000, 64)))
    margin = E.spill(0.98, 64)
    forest = E.Forest(vectors, 6, margin=margin)
    assert all(np.isfinite(cut).all() for tree in forest.thresholds for cut in tree)
    row, code = forest.leaves(vectors, margin)
    assert np.bincount(code).max() < 500 and len(row) < 2 * E.TREES * len(vectors)
