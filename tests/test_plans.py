"""The physical plans that make the operators hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import table_functions
from millrace.functions.tokens import hash_token_ids
from millrace.operators import metrics, sampling, tokenizing
from millrace.operators.batching import with_batches
from millrace.operators.sharding import sharded_fragments, shuffled_fragments
from millrace.operators.shuffling import block_shuffle, chunk_shuffle, seeded_shuffle
from millrace.operators.splitting import split_positions, stratified_split
from millrace.session import pin


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    found = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)[^\n]*", plan_of(df))
    return found


@pytest.fixture
def unbroadcast(spark):
    """Plans as for tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def examples(spark):
    return pin(
        spark.range(2000).selectExpr(
            "concat('x_', id) as id", "if(id % 9 = 0, 'math', 'web') as domain",
            "repeat('word ', 20) as text", "id as pos",
        )
    )


def _payload_exchanges(df, column: str) -> int:
    """Exchanges whose input still carries ``column``."""
    lines = plan_of(df).splitlines()
    count = 0
    for i, line in enumerate(lines):
        if re.search(r"\bExchange \w", line) and "Broadcast" not in line:
            below = "\n".join(lines[i + 1 : i + 3])
            count += column + "#" in below
    return count


def test_shuffle_moves_the_rows_once(examples, unbroadcast):
    df = seeded_shuffle(examples, 1)
    assert _payload_exchanges(df, "text") == 1
    assert "ReadSchema: struct<id:string>" in plan_of(df)  # the counting pass


def test_split_moves_no_rows(spark, examples):
    df = stratified_split(examples, 0.1, 1)
    assert exchanges(df) == []
    assert "BroadcastHashJoin" in plan_of(df)  # one row per domain, counted first
    assert _payload_exchanges(split_positions(df, 1), "text") == 1


def test_shards_count_without_the_arrays(examples, unbroadcast):
    docs = pin(
        examples.select(
            "id", "domain", F.lit("train").alias("split"), F.col("pos").alias("split_pos"),
            hash_token_ids(F.col("text"), 100).alias("ids"), F.lit(20).alias("n_tokens"),
        )
    )
    df = sharded_fragments(docs, 8, 2, 999, 50)
    plan = plan_of(df)
    assert _payload_exchanges(df, "ids") == 1
    assert any(
        "n_tokens" in s and "ids" not in s for s in re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    )
    assert "text" not in plan.split("FileScan")[1].split("]")[0]


def test_slots_need_no_tokens(spark):
    from millrace.operators.sharding import shuffled_fragments, shuffled_slots

    docs = spark.range(300).selectExpr(
        "concat('d', id) as id", "'x' as domain", "if(id % 7 = 0, 'validation', 'train') as split",
        "sequence(1, cast(id % 40 as int) + 1) as ids", "cast(id % 40 as int) + 1 as n_tokens",
    )
    slots = shuffled_slots(docs, 1, 8, 2, 50)
    whole = shuffled_fragments(docs, 1, 8, 2, 999, 50).select(*slots.columns)
    assert sorted(map(tuple, slots.collect())) == sorted(map(tuple, whole.collect()))
    assert slots.dtypes == whole.dtypes and "sequence(1" not in plan_of(slots)


def test_keys_of_samples_hash_no_tokens(spark, sf_dir, monkeypatch):
    from millrace.catalog import reading

    def refused(*_):
        raise AssertionError("token ids are not needed")

    monkeypatch.setattr(reading.tokenizing, "encode_hash", refused)
    assert reading.block_shuffle(spark, sf_dir).count() > 0


def test_split_and_shard_slots_move_the_tokens_once(spark, examples, unbroadcast):
    docs = pin(
        examples.select(
            "id", "domain", F.lit("train").alias("split"),
            hash_token_ids(F.col("text"), 100).alias("ids"), F.lit(20).alias("n_tokens"),
        )
    )
    df = shuffled_fragments(docs, 1, 8, 2, 999, 50)
    assert _payload_exchanges(df, "ids") == 1
    # The same slots as by way of positions.
    placed = pin(split_positions(docs, 1))
    want = sharded_fragments(placed, 8, 2, 999, 50)
    keys = ["original_id", "fragment_idx", "sample_key"]
    assert df.select(keys).exceptAll(want.select(keys)).count() == 0


def test_texts_are_written_once_and_moved_for_their_tokens_only(spark, sf_dir, tmp_path, unbroadcast, monkeypatch):
    """Of all tables a preparation writes, one of each source holds its cleaned text."""
    from millrace.config import CorpusConfig, SourceSpec
    from millrace.plans import prepare
    from millrace.sources import stages

    plans = {}
    get = stages.StageStore.get

    def seen(store, stage, build, *args, **options):
        def built():
            df = build()
            plans[stage] = df
            return df

        return get(store, stage, built, *args, **options)

    monkeypatch.setattr(stages.StageStore, "get", seen)
    config = CorpusConfig(
        sources=(
            SourceSpec("web", f"{sf_dir}/documents.parquet", order=("doc_id",)),
            SourceSpec("math", f"{sf_dir}/conversations.parquet", cleaner="math", order=("conv_id", "turn")),
        ),
        base_path=str(tmp_path), ratios=(0.5,), window=64, stride=8,
    )
    corpus = prepare.prepare_corpus(spark, config, "d")
    assert [s for s, df in plans.items() if "text" in df.columns] == ["kept-web-0", "kept-math-0"]
    assert _payload_exchanges(plans["split"], "text") == 0 and "text" not in corpus.split.columns
    assert len(re.findall(r"ReadSchema: struct<[^\n]*text:string", plan_of(plans["tokens"]))) == 2
    assert plan_of(plans["tokens"]).count("regexp_replace") == 0
    assert {r.id: r.text for r in corpus.clean.collect()}.keys() == {r.id for r in corpus.split.collect()}


def test_table_function_is_seen_through(spark):
    table_functions.register(spark)
    df = spark.sql("SELECT w.* FROM (SELECT array(1, 2, 3) AS ids), LATERAL token_windows(ids, 2, 1, 9) AS w")
    assert "Python" not in plan_of(df) and "Exchange" not in plan_of(df)


def test_fragments_and_hash_tokens_need_no_exchange_and_no_python(examples):
    plan = plan_of(tokenizing.fragments(tokenizing.encode_hash(examples, 100), 8, 2, 999))
    assert "Exchange" not in plan and "Python" not in plan
    assert "pos#" not in plan.split("FileScan")[1].split("]")[0].replace("fragment", "")


def test_vocabulary_lookup_leaves_texts_in_place(examples):
    vocab = tokenizing.vocabulary(examples, 5)
    assert "TakeOrderedAndProject" not in plan_of(vocab) and "SinglePartition" not in exchanges(vocab)
    plan = plan_of(tokenizing.encode_vocab(examples, vocab, 99))
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_reader_order_never_becomes_one_partition(spark, unbroadcast):
    keys = spark.range(5000).selectExpr("id as pos", "cast(id as string) as sample_key")
    order = chunk_shuffle(block_shuffle(keys, 1, 0, "sample_key", 20), 1, 0, 5000, 10, 8)
    df = with_batches(order, 16, drop_last=True, rows=5000)
    assert "SinglePartition" not in exchanges(df)


def test_scoring_stays_in_rows(spark):
    df = spark.range(100).select(
        F.col("id").alias("row_id"), F.array(*[F.rand(i) for i in range(8)]).alias("logits"),
        F.lit(1).alias("target"),
    )
    for out in (
        sampling.sample_next_token(df, "row_id", 1),
        sampling.surviving_tokens(df, "row_id"),
        metrics.predictions(df),
    ):
        assert "Exchange" not in plan_of(out) and "Python" not in plan_of(out)


def test_domain_accuracy_sums_before_the_exchange(spark):
    df = spark.range(100).selectExpr("'web' as domain", "id as correct", "id as total")
    plan = plan_of(metrics.domain_accuracy(df))
    assert plan.index("Exchange") < plan.index("partial_sum")
