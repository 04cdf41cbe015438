import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import order_hash, uniform
from millrace.operators.joining import join_lookup
from millrace.operators import shuffling
from millrace.operators.ranking import dense_index, rank_by_hash, running_total
from millrace.operators.shuffling import (
    block_shuffle,
    chunk_shuffle,
    read_positions,
    seeded_shuffle,
    shard_order,
)
from millrace.session import pin


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """1,000 rows; one group holds nearly all; one leading key holds a third."""
    rows = [
        ("big" if i % 50 else f"g{i % 3}", 7 if i % 3 == 0 else i, i, f"id_{i}")
        for i in range(1000)
    ]
    return spark.createDataFrame(rows, "grp string, lead int, tail int, id string")


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_dense_index_is_exact_under_any_partitioning(skewed, parts):
    got = dense_index(skewed.repartition(parts, "tail"), ["lead", "tail"]).collect()
    want = sorted(got, key=lambda r: (r.lead, r.tail))
    assert [r.idx for r in want] == list(range(1000))
    assert {r.id for r in got} == {f"id_{i}" for i in range(1000)}


def test_dense_index_within_groups_and_first(skewed):
    got = dense_index(skewed, ["lead", "tail"], by=["grp"], first=20).collect()
    for grp in ("big", "g0", "g1", "g2"):
        mine = sorted((r for r in skewed.collect() if r.grp == grp), key=lambda r: (r.lead, r.tail))
        want = [(r.id, i) for i, r in enumerate(mine[:20])]
        assert sorted(((r.id, r.idx) for r in got if r.grp == grp), key=lambda t: t[1]) == want


def test_dense_index_gives_repeated_keys_one_index_each(spark):
    df = spark.createDataFrame([(1, v) for v in "abc"] + [(0, "z")], "k long, v string")
    got = dense_index(df, ["k"]).collect()
    assert sorted(r.idx for r in got) == [0, 1, 2, 3] and {r.v for r in got} == set("abcz")
    assert [r.idx for r in got if r.v == "z"] == [0]


def test_dense_index_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, "n"), (2, "b"), (1, "a")], "k int, v string")
    assert {r.v: r.idx for r in dense_index(df, ["k"]).collect()} == {"n": 0, "a": 1, "b": 2}


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_seeded_shuffle_is_the_md5_order(skewed, parts):
    got = seeded_shuffle(skewed.repartition(parts), 5).collect()
    want = sorted((f"id_{i}" for i in range(1000)), key=lambda k: (md5(f"5:{k}"), k))
    assert [r.id for r in sorted(got, key=lambda r: r.shuffle_pos)] == want


def test_rank_by_hash_with_weight_and_groups(skewed):
    got = rank_by_hash(
        skewed, order_hash(1, F.col("id")), ["id"], ["grp"],
        {"pos": F.col("tail") % 4, "rank": None}, hex_digits=2,
    ).collect()
    for grp in {r.grp for r in got}:
        total = 0
        mine = [r for r in got if r.grp == grp]
        for i, r in enumerate(sorted(mine, key=lambda r: md5(f"1:{r.id}"))):
            assert (r.pos, r.rank) == (total, i)
            total += r.tail % 4


@pytest.mark.parametrize("bin_size", [1, 7, 5000])
def test_running_total(spark, bin_size):
    df = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("w"))
    got = {r.pos: r.start for r in running_total(df, "pos", F.col("w"), bin_size=bin_size).collect()}
    total = 0
    for i in range(500):
        assert got[i] == total
        total += i % 5


@pytest.fixture(scope="module")
def samples(spark):
    """137 samples in shards of 10, the last one short."""
    return spark.range(137).selectExpr(
        "cast(id div 10 as int) as shard_idx",
        "cast(id % 10 as int) as shard_pos",
        "format_string('%05d_%05d', id div 10, id % 10) as sample_key",
    )


def _keys(df):
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [r.sample_key for r in rows]


def test_shards_are_read_in_shuffled_order(samples):
    keys = _keys(read_positions(samples, 1, 0))
    order = sorted(range(14), key=lambda s: md5(f"1:0:{s}"))
    want = [f"{s:05d}_{i:05d}" for s in order for i in range(7 if s == 13 else 10)]
    assert keys == want
    assert keys != _keys(read_positions(samples, 1, 1))


def test_shard_order_starts(samples):
    shards = samples.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(shard_order(shards, 1, 0).collect(), key=lambda r: r.shard_rank)
    assert [r.shard_rank for r in rows] == list(range(14))
    assert [r.first_pos for r in rows] == [sum(x.n for x in rows[:i]) for i in range(14)]


def test_block_shuffle_stays_in_its_block(samples):
    before = _keys(read_positions(samples, 1, 0))
    after = _keys(block_shuffle(read_positions(samples, 1, 0), 1, 0, "sample_key", 16))
    assert before != after
    for start in range(0, 137, 16):
        block = before[start : start + 16]
        assert after[start : start + 16] == sorted(block, key=lambda k: md5(f"1:0:{k}"))


def test_chunk_shuffle_moves_whole_chunks(samples):
    base = read_positions(samples, 1, 0)
    before, after = _keys(base), _keys(chunk_shuffle(base, 1, 0, 137, chunk=8, group=5))
    chunks = [before[i : i + 8] for i in range(0, 137, 8)]
    want = []
    for g in range(0, len(chunks), 5):
        numbers = range(g, min(g + 5, len(chunks)))
        for c in sorted(numbers, key=lambda c: md5(f"1:0:{c}")):
            want += chunks[c]
    assert after == want


def test_uniform_is_reproducible_and_spread(spark):
    us = [r.u for r in spark.range(2000).select(uniform(3, F.col("id")).alias("u")).collect()]
    assert all(0 <= u < 1 for u in us)
    assert abs(sum(us) / 2000 - 0.5) < 0.03
    assert us == [r.u for r in spark.range(2000).select(uniform(3, F.col("id")).alias("u")).collect()]


@pytest.mark.parametrize("rows", [10, 1])
def test_lookup_join_small_and_large(spark, skewed, rows):
    lookup = pin(
        spark.createDataFrame([("big", 1), ("g0", 2), (None, 3)], "grp string, v int")
    )
    left = skewed.union(spark.createDataFrame([(None, 1, 5000, "id_null")], skewed.schema))
    got = {r.id: r.v for r in join_lookup(left, lookup, "grp", "id", rows).collect()}
    want = {"big": 1, "g0": 2, None: 3}
    assert got == {r.id: want.get(r.grp) for r in left.collect()}


def test_a_salted_lookup_is_never_broadcast(spark, skewed):
    lookup = pin(spark.range(50).selectExpr("concat('g', id) as grp", "id as v"))
    joined = join_lookup(skewed, lookup, "grp", "id", 10)
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buffer", [1, 2, 37, 5000])
def test_buffer_shuffle_moves_less_than_its_buffer(spark, buffer):
    rows = spark.range(4000).selectExpr("id as pos", "concat('k', id) as sample_key", "id * 2 as other")
    a = shuffling.buffer_shuffle(rows.repartition(7), 1, 0, "sample_key", buffer)
    assert a.columns == rows.columns
    got = {r.sample_key: r.pos for r in a.collect()}
    assert sorted(got.values()) == list(range(4000))
    moved = [got[f"k{i}"] - i for i in range(4000)]
    assert max(map(abs, moved)) < max(buffer, 1)
    # Rows cross the borders of blocks as long as the buffer.
    crossing = {min(i, got[f"k{i}"]) // buffer for i in range(4000) if i // buffer != got[f"k{i}"] // buffer}
    assert len(crossing) == {1: 0, 2: len(crossing), 37: 4000 // 37, 5000: 0}[buffer] and (buffer != 2 or crossing)
    again = shuffling.buffer_shuffle(rows.repartition(2), 1, 0, "sample_key", buffer)
    assert {r.sample_key: r.pos for r in again.collect()} == got
    other = shuffling.buffer_shuffle(rows, 1, 1, "sample_key", buffer)
    assert buffer == 1 or {r.sample_key: r.pos for r in other.collect()} != got
    with pytest.raises(ValueError):
        shuffling.buffer_shuffle(rows, 1, 0, "sample_key", 0)
