"""The whole preparation as users call it, on the given tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.corpus import QUOTA_RATIO
from millrace.catalog.inputs import (
    EXAMPLES_CTE,
    MATH,
    MIN_WORDS,
    SEED,
    VAL_RATIO,
    WEB,
    cleaned_cte,
    examples_cte,
    table,
)
from millrace.catalog.reading import SHARD_CTE, SHARD_SIZE, chunk_cte
from millrace.catalog.tokens import HASH_VOCAB, LENGTH, PAD_ID, PADDED, STRIDE, joined
from millrace.config import CorpusConfig, SourceSpec
from millrace.plans.prepare import PreparedCorpus, prepare_corpus
from millrace.session import scratch_path

BATCH, BUFFER, EPOCH = 16, 40, 2
DATE = "2024-01-01"


def prepared(spark: SparkSession, sf_dir: str) -> PreparedCorpus:
    """Two sources with quotas that bind, prepared; the second call only reads stages."""
    total = sum(table(spark, sf_dir, t).count() for t in ("documents", "conversations"))
    config = CorpusConfig(
        sources=(
            SourceSpec(WEB, f"{sf_dir}/documents.parquet", cleaner="web", order=("doc_id",)),
            SourceSpec(MATH, f"{sf_dir}/conversations.parquet", cleaner="math", order=("conv_id", "turn")),
        ),
        base_path=scratch_path(spark, "prepared"),
        max_examples=total // 2,
        ratios=(QUOTA_RATIO,),
        min_words_exclusive=MIN_WORDS,
        val_ratio=VAL_RATIO,
        seed=SEED,
        window=LENGTH,
        stride=STRIDE,
        shard_size=SHARD_SIZE,
        vocab_size=HASH_VOCAB,
        pad_id=PAD_ID,
        batch_size=BATCH,
        shuffle_buffer=BUFFER,
    )
    prepare_corpus(spark, config, DATE)
    return prepare_corpus(spark, config, DATE)


def prepared_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).clean.select("id", "domain", "text", "pos")


def prepared_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).split.select("id", "domain", "split")


def prepared_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).fragments.select(
        "split", "original_id", "domain", "fragment_idx", "sample_key", joined("input_ids").alias("input_ids")
    )


def prepared_train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).train_batches(EPOCH).select("sample_key", "batch_id", "batch_pos")


def prepared_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir).store.manifest()
    return rows.filter(F.col("stage").isin("split", "tokens", "fragments"))


_CLEANED = cleaned_cte(
    "(SELECT doc_id AS ord, text FROM documents)",
    "(SELECT conv_id * 1000 + turn AS ord, text FROM conversations)",
)
_TAKEN = f"""(
    SELECT n.* FROM numbered_kept n,
        (SELECT ((SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations)) // 2 AS total) q
    WHERE idx < CASE WHEN source_no = 0 THEN CAST(floor(total * CAST({QUOTA_RATIO} AS DOUBLE)) AS BIGINT)
                ELSE total - CAST(floor(total * CAST({QUOTA_RATIO} AS DOUBLE)) AS BIGINT) END)"""
_EXAMPLES = examples_cte(_CLEANED, _TAKEN)
_SHARDS = SHARD_CTE.replace(EXAMPLES_CTE, _EXAMPLES)
_CHUNKS = chunk_cte(_SHARDS, EPOCH, BUFFER // 2, 500, 1000)

QUERIES = {
    "prepared_clean": prepared_clean,
    "prepared_split": prepared_split,
    "prepared_fragments": prepared_fragments,
    "prepared_train_batches": prepared_train_batches,
    "prepared_manifest": prepared_manifest,
}

ORACLES = {
    "prepared_clean": f"WITH {_EXAMPLES} SELECT id, domain, text, pos FROM examples",
    "prepared_split": f"WITH {_SHARDS} SELECT id, domain, split FROM marked",
    "prepared_fragments": f"""WITH {_SHARDS}
        SELECT split, original_id, domain, fragment_idx, sample_key,
               array_to_string({PADDED}, ',') AS input_ids FROM sharded""",
    "prepared_train_batches": f"""WITH {_CHUNKS}
        SELECT sample_key, pos // {BATCH} AS batch_id, CAST(pos % {BATCH} AS INTEGER) AS batch_pos
        FROM chunks WHERE pos // {BATCH} < (SELECT count(*) FROM chunks) // {BATCH}""",
    "prepared_manifest": f"""WITH {_SHARDS}
        SELECT 'split' AS stage, split, count(*) AS rows, NULL::BIGINT AS shards FROM marked GROUP BY split
        UNION ALL
        SELECT 'tokens', split, count(*), NULL FROM tokens GROUP BY split
        UNION ALL
        SELECT 'fragments', split, count(*), CAST(max(shard_idx) + 1 AS BIGINT) FROM sharded GROUP BY split""",
}
