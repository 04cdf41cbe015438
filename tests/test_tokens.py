import hashlib
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import table_functions
from millrace.functions.tokens import (
    attention_mask,
    fragment_count,
    hash_token_ids,
    pad_right,
    shift_inputs,
    shift_targets,
    token_windows,
    truncate_at_eos,
)
from millrace.operators.batching import collate, limit_batches, with_batches
from millrace.operators.sharding import shard_summary, sharded_fragments
from millrace.operators.tokenizing import (
    encode_by_join,
    encode_hash,
    encode_vocab,
    encode_with,
    fragments,
    vocabulary,
)


def windows(ids, length, stride):
    step = length - stride
    n = len(ids)
    k = 1 if n <= length else 1 + math.ceil((n - length) / step)
    return [ids[j * step : j * step + length] for j in range(k)]


@pytest.mark.parametrize("length,stride", [(8, 2), (5, 0), (7, 6), (1, 0)])
def test_windows_padding_and_mask(spark, length, stride):
    df = spark.range(60).selectExpr(
        "cast(id as int) as n",
        "if(id = 0, cast(array() as array<int>), sequence(1, cast(id as int))) as ids",
    )
    rows = df.select(
        "n",
        fragment_count(F.col("n"), length, stride).alias("k"),
        F.posexplode(token_windows(F.col("ids"), length, stride)).alias("j", "w"),
    ).select(
        "n", "k", "j", "w",
        pad_right(F.col("w"), length, 99).alias("p"),
        attention_mask(F.col("w"), length).alias("m"),
    ).collect()
    for n in range(60):
        mine = sorted((r for r in rows if r.n == n), key=lambda r: r.j)
        want = windows(list(range(1, n + 1)), length, stride)
        assert [r.w for r in mine] == want and {r.k for r in mine} == {len(want)}
        for r in mine:
            assert r.p == r.w + [99] * (length - len(r.w))
            assert r.m == [1] * len(r.w) + [0] * (length - len(r.w))


def test_table_function_in_sql(spark):
    table_functions.register(spark)
    for n in (0, 1, 8, 9, 14, 15, 33):
        ids = list(range(1, n + 1))
        text = f"cast(array({', '.join(map(str, ids))}) as array<int>)"
        rows = spark.sql(f"SELECT * FROM token_windows({text}, 8, 2, 99)").collect()
        want = windows(ids, 8, 2)
        assert [r.input_ids for r in rows] == [w + [99] * (8 - len(w)) for w in want]
        assert [sum(r.attention_mask) for r in rows] == [len(w) for w in want]
        assert [r.fragment_idx for r in rows] == list(range(len(want)))


def test_window_arguments(spark):
    with pytest.raises(ValueError):
        token_windows(F.array(), 8, 8)


def test_hash_ids(spark):
    df = spark.createDataFrame([("a bb",), ("",)], "text string")
    got = [r.ids for r in df.select(hash_token_ids(F.col("text"), 1000).alias("ids")).collect()]
    assert got == [[int(hashlib.md5(w).hexdigest()[:8], 16) % 1000 for w in (b"a", b"bb")], []]


def test_shift_and_stop_rule(spark):
    df = spark.createDataFrame([([1, 2, 3], 3), ([4], 3), ([], 0)], "ids array<int>, p int")
    rows = df.select(shift_inputs(F.col("ids")).alias("i"), shift_targets(F.col("ids")).alias("t"))
    assert [(r.i, r.t) for r in rows.collect()] == [([1, 2], [2, 3]), ([], []), ([], [])]
    eos = spark.createDataFrame(
        [([7, 7, 1, 7, 2, 7], 3), ([1, 2, 3], 3), ([1] * 30, 0), ([], 3)], "ids array<int>, p int"
    )
    cut = truncate_at_eos(F.col("ids"), F.col("p"), 7, min_length=5, max_length=20)
    got = [r.c for r in eos.select(cut.alias("c")).collect()]
    assert got == [[7, 7, 1, 7], [1, 2, 3], [1] * 20, []]


@pytest.fixture(scope="module")
def texts(spark):
    """One token makes up a third of all; one row is empty."""
    rows = [(f"web_{i}", "web", " ".join(["hot", f"w{i % 17}", f"x{i}"] * (i % 9))) for i in range(200)]
    return spark.createDataFrame(rows, "id string, domain string, text string")


def test_both_vocabulary_encodings_agree(texts):
    vocab = vocabulary(texts, 10, first_id=2)
    entries = {r.token: r.token_id for r in vocab.collect()}
    assert sorted(entries.values()) == list(range(2, 12)) and entries["hot"] == 2
    want = {
        r.id: [entries.get(w, 1) for w in r.text.split()] for r in texts.collect()
    }
    for df in (
        encode_vocab(texts, vocab, 1),
        encode_vocab(texts, vocab, 1, max_lookup=3),
        encode_vocab(texts, vocab, 1, max_lookup=0),
        encode_by_join(texts, vocab, 1),
    ):
        assert {r.id: r.ids for r in df.collect()} == want


def test_both_encodings_agree_on_repeated_and_missing_keys_and_texts(spark):
    rows = [("x", "a b"), ("x", "b  a  c"), (None, "a"), ("y", None), ("z", ""), (None, " c ")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("", 9)], "token string, token_id int")
    lookup = {"a": 5, "b": 6}
    want = sorted((str(i), str(t), [lookup.get(w, 1) for w in (t or "").split()]) for i, t in rows)
    for out in (encode_vocab(df, vocab, 1), encode_vocab(df, vocab, 1, max_lookup=1)):
        assert out.columns == ["id", "text", "ids"]
        assert sorted((str(r.id), str(r.text), r.ids) for r in out.collect()) == want


def test_supplied_tokenizer(texts):
    class Lengths:
        def encode(self, batch):
            return [[len(w) for w in t.split()] for t in batch]

    got = {r.id: r.ids for r in encode_with(texts, Lengths).collect()}
    assert got == {r.id: [len(w) for w in r.text.split()] for r in texts.collect()}


def test_fragments_rebuild_the_document(texts):
    length, stride = 6, 2
    coded = encode_hash(texts, 1000)
    rows = fragments(coded, length, stride, pad_id=5000).collect()
    for doc in coded.collect():
        mine = sorted((r for r in rows if r.original_id == doc.id), key=lambda r: r.fragment_idx)
        tokens = []
        for r in mine:
            real = [t for t, m in zip(r.input_ids, r.attention_mask) if m]
            assert len(r.input_ids) == len(r.attention_mask) == length
            tokens += real[stride:] if r.fragment_idx else real
        assert tokens == doc.ids
        assert all(sum(r.attention_mask) == length for r in mine[:-1])


def test_shards_fill_in_document_order(texts):
    docs = encode_hash(texts, 1000).selectExpr(
        "*", "size(ids) as n_tokens", "'train' as split", "cast(substring(id, 5) as bigint) as split_pos"
    )
    sharded = sharded_fragments(docs, 6, 2, 5000, 25)
    rows = sorted(sharded.collect(), key=lambda r: (r.shard_idx, r.shard_pos))
    assert [(r.shard_idx, r.shard_pos) for r in rows] == [divmod(i, 25) for i in range(len(rows))]
    order = [(int(r.original_id[4:]), r.fragment_idx) for r in rows]
    assert order == sorted(order)
    assert rows[0].sample_key == "00000_00000" and rows[26].sample_key == "00001_00001"
    summary = shard_summary(sharded).first()
    assert (summary.n_fragments, summary.n_shards) == (len(rows), rows[-1].shard_idx + 1)


def test_batches(spark):
    df = spark.range(150).selectExpr("id as pos", "id * 2 as v")
    for rows in (None, 150):
        train = with_batches(df, 64, drop_last=True, rows=rows)
        assert train.count() == 128 and train.select("batch_id").distinct().count() == 2
    val = with_batches(df, 64, drop_last=False)
    packed = sorted(collate(val, "v").collect(), key=lambda r: r.batch_id)
    assert [r.n for r in packed] == [64, 64, 22]
    assert [x for r in packed for x in r.v] == [2 * i for i in range(150)]
    assert limit_batches(val, 2).count() == 128
    assert with_batches(df.limit(0), 64, drop_last=True).count() == 0


def test_token_table_finds_what_an_index_finds():
    import random

    import numpy as np
    import pyarrow as pa

    from millrace.functions.token_table import TokenTable, look_up

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé語 ") for _ in range(rng.randrange(0, 6)))
    names = sorted({word() for _ in range(900)})
    table = TokenTable(pa.array(names), pa.array(range(len(names)), pa.int32()))
    asked = [*names, *{word() for _ in range(900)}]
    number = {n: i for i, n in enumerate(names)}
    assert table.find(pa.array(asked)).to_pylist() == [number.get(a) for a in asked]
    # One hash for two names, or a hash of other bytes: what counts is the name itself.
    table.hashes = np.sort(np.concatenate([table.hashes[:1], table.hashes[:-1]]))
    table.clash = True
    assert table.find(pa.array(asked)).to_pylist() == [number.get(a) for a in asked]
    texts = [" ".join(rng.choices(asked, k=5)) for _ in range(50)] + [None, "", "   "]
    got = look_up(pa.array(texts), TokenTable(pa.array(names), pa.array(range(len(names)), pa.int32()))).to_pylist()
    assert got == [[number.get(w) for w in (t or "").split(" ") if w] for t in texts]
    none = TokenTable(pa.array([], pa.string()), pa.array([], pa.int32()))
    assert none.find(pa.array(["a"])).to_pylist() == [None]


def test_long_columns_are_looked_up_in_slices(monkeypatch):
    import pyarrow as pa

    from millrace.functions import token_table

    texts = pa.array(["a b", None, "", "c a" * 40, "b", " a  c ", None])
    table = token_table.TokenTable(pa.array(["a", "c"]), pa.array([0, 1], pa.int32()))
    want, seen = token_table.look_up(texts, table).to_pylist(), []
    split = token_table.pc.split_pattern
    monkeypatch.setattr(token_table, "LOOK_UP_BYTES", 4)
    monkeypatch.setattr(token_table.pc, "split_pattern", lambda t, p: seen.append(len(t)) or split(t, p))
    assert token_table.look_up(texts, table).to_pylist() == want and len(seen) > 2
    assert token_table.look_up(texts.slice(0, 0), table).to_pylist() == []


@pytest.mark.parametrize("small", [0, 10])
def test_a_small_vocabulary_leaves_tokens_in_place(spark, small):
    df = spark.createDataFrame([(1, "a b a"), (1, None), (None, ""), (2, "c b z")], "k int, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id int")
    out = encode_by_join(df, vocab, 9, small=small)
    assert sorted(tuple(r.ids) for r in out.collect()) == [(), (), (0, 1, 0), (2, 1, 9)]
    assert ("hashpartitioning(token" not in out._jdf.queryExecution().executedPlan().toString()) == (small > 0)


def test_a_vocabulary_in_two_parts_with_a_hot_unknown_token(spark):
    """A third of all tokens are not in the vocabulary at all, others only in its tail."""
    rows = [(i, " ".join(["zz", f"t{i % 40}", f"t{i % 7}"] * (i % 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, text string").repartition(4)
    vocab = spark.createDataFrame([(f"t{i}", 100 - i) for i in range(38)], "token string, token_id int")
    want = {n: [100 - int(w[1:]) if w != "zz" and int(w[1:]) < 38 else -7 for w in t.split()] for n, t in rows}
    for limit in (1000, 38, 37, 5, 1):
        got = encode_vocab(df, vocab, -7, max_lookup=limit)
        assert got.columns == ["n", "text", "ids"] and {r.n: r.ids for r in got.collect()} == want
