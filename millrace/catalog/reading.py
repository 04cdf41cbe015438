"""Shards, reader shuffles and batches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.inputs import MIN_WORDS, SEED, VAL_RATIO, examples, sources
from millrace.catalog.splits import SPLIT_CTE
from millrace.catalog.tokens import (
    HASH_VOCAB,
    LENGTH,
    MASK,
    PAD_ID,
    PADDED,
    STRIDE,
    _ids_sql,
    joined,
    windows_sql,
)
from millrace.functions.tokens import words
from millrace.operators import batching, sharding, shuffling, splitting, tokenizing
from millrace.operators.quota import number_sources
from millrace.session import delete_folder, pin, scratch_path, unpin
from millrace.sources.stages import StageStore
from millrace.sources.tar_shards import (
    bad_samples,
    list_shards,
    open_fs,
    read_shards,
    verify_shards,
    write_shards,
)

SHARD_SIZE = 200
EPOCH = 3
BUFFER, CHUNK, GROUP = 40, 10, 8
BATCH = 16
LIMIT = 5
SPLIT_BYTES = 200_000
WAVES, WAVE_SHARDS = 8, 128


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all examples and their splits, written; the split is found without the texts,
    which do not move and are deleted."""
    texts: list[DataFrame] = []

    def save(rows: DataFrame, label: str) -> DataFrame:
        texts.append(pin(rows, label))
        return texts[-1]

    numbered = number_sources(sources(spark, sf_dir), [None, None], MIN_WORDS, save)
    marked = splitting.stratified_split(numbered.index, VAL_RATIO, SEED).drop("pos")
    coded = tokenizing.encode_hash(numbered.texts, HASH_VOCAB).drop("text")
    tokens = coded.join(marked, ["domain", "_row"]).select("id", "domain", "split", "ids")
    stored = pin(tokens.withColumn("n_tokens", F.size("ids")), "tokens")
    unpin(*texts)
    return stored


def _cut(tokens: DataFrame) -> DataFrame:
    return sharding.shuffled_fragments(tokens, SEED, LENGTH, STRIDE, PAD_ID, SHARD_SIZE)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(_tokens(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sharded``, written; the tokens it is made of are deleted."""
    tokens = _tokens(spark, sf_dir)
    rows = pin(_cut(tokens), "sharded")
    unpin(tokens)
    return rows


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sharded`` without token ids, for what needs the places only: words are counted, not
    hashed."""
    marked = splitting.stratified_split(examples(spark, sf_dir), VAL_RATIO, SEED)
    counted = marked.select("id", "domain", "split", F.size(words(F.col("text"))).alias("n_tokens"))
    return sharding.shuffled_slots(pin(counted, "token-counts"), SEED, LENGTH, STRIDE, SHARD_SIZE)


def _keys(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    columns = ["sample_key", "shard_idx", "shard_pos"]
    rows = _slots(spark, sf_dir).filter(F.col("split") == split)
    return pin(rows.select(*columns), "keys")


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select(
        "split", "original_id", "domain", "fragment_idx", "shard_idx", "shard_pos", "sample_key"
    )


def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_summary(_slots(spark, sf_dir))


def stage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StageStore(spark, scratch_path(spark, "stages"), "demo")
    store.get("fragments", lambda: sharded(spark, sf_dir), ["split"])
    return store.manifest()


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the tar shards of both splits."""
    path = scratch_path(spark, "shards")
    rows = _stored(spark, sf_dir)
    for split in (splitting.TRAIN, splitting.VALIDATION):
        write_shards(rows.filter(F.col("split") == split), path, split)
    unpin(rows)
    return path


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sample_key",
        "original_id",
        "domain",
        "fragment_idx",
        joined("text").alias("text"),
        joined("attention_mask").alias("attention_mask"),
        "shard",
    )


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _exported(spark, sf_dir)
    return _read_back(
        read_shards(spark, path, splitting.TRAIN).unionByName(
            read_shards(spark, path, splitting.VALIDATION)
        )
    )


def shard_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard of both splits is written and checked whole. Shards take some ten times the
    room of the texts, so those of a split are written in ``WAVES`` parts (of ``WAVE_SHARDS`` at
    least), and a part is deleted when its verdicts are written."""
    rows = _stored(spark, sf_dir)
    verdicts = []
    for split in (splitting.TRAIN, splitting.VALIDATION):
        of_split = rows.filter(F.col("split") == split)
        n = (of_split.agg(F.max("shard_idx")).first()[0] or 0) + 1
        wave = max(WAVE_SHARDS, -(-n // WAVES))
        for first in range(0, n, wave):
            path = scratch_path(spark, "shards")
            write_shards(of_split.filter(F.col("shard_idx").between(first, first + wave - 1)), path, split)
            checked = verify_shards(spark, path, split, every_n=1, max_members=None)
            verdicts.append(pin(checked, "verdicts"))
            delete_folder(spark, path)
    unpin(rows)
    return reduce(DataFrame.unionByName, verdicts)


def _damaged(spark: SparkSession, sf_dir: str) -> str:
    """The shards with three of them damaged: shard 0 of train is cut off within its
    first member, shard 0 of validation is no tar, and in shard 1 of train a byte of
    the first sample's description is not UTF-8. Fixed members of a few known files are
    rewritten here, in place of what a bad disk does."""
    path = _exported(spark, sf_dir)
    fs, root = open_fs(path)
    stored = {s.name: s.file for split in (splitting.TRAIN, splitting.VALIDATION) for s in list_shards(path, split)}

    def rewrite(shard: str, change) -> None:
        name = stored[shard]
        with fs.open_input_stream(f"{root}/{name}") as f:
            content = f.read()
        fs.delete_file(f"{root}/{name}")
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(change(content))

    rewrite("train-00000.tar", lambda c: c[:520])
    rewrite("validation-00000.tar", lambda c: b"not a tar file " * 100)
    rewrite("train-00001.tar", lambda c: re.sub(rb'(?<="original_id":").', lambda _: b"\xff", c, count=1))
    return path


def shard_bad_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _damaged(spark, sf_dir)
    both = bad_samples(spark, path, splitting.TRAIN).unionByName(
        bad_samples(spark, path, splitting.VALIDATION)
    )
    return both.select("shard", "sample_key", F.split("error", ":")[0].alias("error"))


def shard_tolerant_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _damaged(spark, sf_dir)
    return _read_back(
        read_shards(spark, path, splitting.TRAIN, "DROPMALFORMED").unionByName(
            read_shards(spark, path, splitting.VALIDATION, "DROPMALFORMED")
        )
    )


def shard_split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard read in pieces of a few kilobytes; where there are many, a task reads several."""
    path = _exported(spark, sf_dir)
    parts = [read_shards(spark, path, split, split_bytes=SPLIT_BYTES) for split in (splitting.TRAIN, splitting.VALIDATION)]
    return _read_back(parts[0].unionByName(parts[1]))


def shard_verify_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = verify_shards(spark, _damaged(spark, sf_dir), every_n=1, max_members=None)
    return checked.select("shard", "ok", F.split("error", ":")[0].alias("error"))


def shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir, splitting.TRAIN)
    shards = keys.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n"))
    return shuffling.shard_order(pin(shards, "shards"), SEED, EPOCH)


def _blocks(keys: DataFrame) -> DataFrame:
    positions = shuffling.read_positions(keys, SEED, EPOCH)
    return shuffling.block_shuffle(positions, SEED, EPOCH, "sample_key", BUFFER // 2)


def _chunks(keys: DataFrame) -> DataFrame:
    return shuffling.chunk_shuffle(_blocks(keys), SEED, EPOCH, keys.count(), CHUNK, GROUP)


def block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(_keys(spark, sf_dir, splitting.TRAIN)).select("sample_key", "pos")


def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = shuffling.read_positions(_keys(spark, sf_dir, splitting.TRAIN), SEED, EPOCH)
    return shuffling.buffer_shuffle(positions, SEED, EPOCH, "sample_key", BUFFER).select("sample_key", "pos")


def chunk_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(_keys(spark, sf_dir, splitting.TRAIN)).select("sample_key", "pos")


def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir, splitting.TRAIN)
    rows = keys.count()
    return batching.with_batches(_chunks(keys), BATCH, drop_last=True, rows=rows).select(
        "sample_key", "batch_id", "batch_pos"
    )


def _val(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir, splitting.VALIDATION)
    pos = F.col("shard_idx").cast("bigint") * SHARD_SIZE + F.col("shard_pos")
    return batching.with_batches(keys.withColumn("pos", pos), BATCH, drop_last=False)


def val_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _val(spark, sf_dir).select("sample_key", "batch_id", "batch_pos")


def limit_val_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.limit_batches(_val(spark, sf_dir), LIMIT).select("sample_key", "batch_id")


def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = batching.collate(_val(spark, sf_dir), "sample_key")
    return packed.select("batch_id", "n", F.array_join("sample_key", ",").alias("sample_keys"))


SHARD_CTE = f"""{SPLIT_CTE},
tokens AS (SELECT id, domain, split, split_pos, {_ids_sql(HASH_VOCAB)} AS ids FROM placed),
{windows_sql("tokens", "split, split_pos,")},
slots AS (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY split_pos, fragment_idx) - 1 AS slot
    FROM cuts),
sharded AS (
    SELECT *, CAST(slot // {SHARD_SIZE} AS INTEGER) AS shard_idx,
           CAST(slot % {SHARD_SIZE} AS INTEGER) AS shard_pos,
           printf('%05d_%05d', slot // {SHARD_SIZE}, slot % {SHARD_SIZE}) AS sample_key
    FROM slots)"""

_SAMPLE_SQL = f"""sample_key, original_id, domain, fragment_idx,
               array_to_string({PADDED}, ',') AS text, array_to_string({MASK}, ',')
               AS attention_mask, printf('%s-%05d.tar', split, shard_idx) AS shard"""

def order_cte(shards: str, epoch: int) -> str:
    return f"""{shards},
shards AS (SELECT shard_idx, count(*) AS n FROM sharded WHERE split = 'train' GROUP BY shard_idx),
shard_order AS (
    SELECT *, row_number() OVER w - 1 AS shard_rank, CAST(sum(n) OVER w - n AS BIGINT) AS first_pos
    FROM shards WINDOW w AS (ORDER BY md5('{SEED}:{epoch}:' || shard_idx), shard_idx))"""


def block_cte(shards: str, epoch: int, block: int) -> str:
    return f"""{order_cte(shards, epoch)},
positions AS (
    SELECT sample_key, first_pos + shard_pos AS pos
    FROM sharded JOIN shard_order USING (shard_idx) WHERE split = 'train'),
blocks AS (
    SELECT sample_key, row_number() OVER (
               ORDER BY pos // {block}, md5('{SEED}:{epoch}:' || sample_key), sample_key) - 1 AS pos
    FROM positions)"""


def chunk_cte(shards: str, epoch: int, block: int, chunk: int, group: int) -> str:
    return f"""{block_cte(shards, epoch, block)},
chunks AS (
    SELECT sample_key, row_number() OVER (ORDER BY pos // {chunk * group},
               md5('{SEED}:{epoch}:' || (pos // {chunk})), pos // {chunk}, pos) - 1 AS pos
    FROM blocks)"""


_ORDER_CTE = order_cte(SHARD_CTE, EPOCH)
_BLOCK_CTE = block_cte(SHARD_CTE, EPOCH, BUFFER // 2)
_CHUNK_CTE = chunk_cte(SHARD_CTE, EPOCH, BUFFER // 2, CHUNK, GROUP)

_VAL_CTE = f"""{SHARD_CTE},
val AS (
    SELECT sample_key, CAST(slot // {BATCH} AS BIGINT) AS batch_id,
           CAST(slot % {BATCH} AS INTEGER) AS batch_pos
    FROM sharded WHERE split = 'validation')"""

QUERIES = {
    "shard_assign": shard_assign,
    "shard_summary": shard_summary,
    "stage_manifest": stage_manifest,
    "shard_roundtrip": shard_roundtrip,
    "shard_split_read": shard_split_read,
    "shard_verify": shard_verify,
    "shard_bad_samples": shard_bad_samples,
    "shard_tolerant_read": shard_tolerant_read,
    "shard_verify_broken": shard_verify_broken,
    "shard_order": shard_order,
    "block_shuffle": block_shuffle,
    "buffer_shuffle": buffer_shuffle,
    "chunk_shuffle": chunk_shuffle,
    "train_batches": train_batches,
    "val_batches": val_batches,
    "limit_val_batches": limit_val_batches,
    "collated_batches": collated_batches,
}

ORACLES = {
    "shard_assign": f"""WITH {SHARD_CTE}
        SELECT split, original_id, domain, fragment_idx, shard_idx, shard_pos, sample_key
        FROM sharded""",
    "shard_summary": f"""WITH {SHARD_CTE}
        SELECT split, count(*) AS n_fragments, CAST(max(shard_idx) + 1 AS BIGINT) AS n_shards
        FROM sharded GROUP BY split""",
    "stage_manifest": f"""WITH {SHARD_CTE}
        SELECT 'fragments' AS stage, split, count(*) AS rows,
               CAST(max(shard_idx) + 1 AS BIGINT) AS shards
        FROM sharded GROUP BY split""",
    "shard_roundtrip": f"""WITH {SHARD_CTE}
        SELECT {_SAMPLE_SQL} FROM sharded""",
    "shard_verify": f"""WITH {SHARD_CTE}
        SELECT printf('%s-%05d.tar', split, shard_idx) AS shard, true AS ok, NULL::VARCHAR AS error,
               CAST(3 * count(*) AS INTEGER) AS members
        FROM sharded GROUP BY split, shard_idx""",
    "shard_bad_samples": """
        SELECT 'train-00000.tar' AS shard, NULL::VARCHAR AS sample_key, 'ReadError' AS error
        UNION ALL SELECT 'validation-00000.tar', NULL, 'ReadError'
        UNION ALL SELECT 'train-00001.tar', '00001_00000', 'UnicodeDecodeError'""",
    "shard_tolerant_read": f"""WITH {SHARD_CTE}
        SELECT {_SAMPLE_SQL} FROM sharded
        WHERE shard_idx > 0 AND NOT (split = 'train' AND sample_key = '00001_00000')""",
    "shard_split_read": f"""WITH {SHARD_CTE}
        SELECT {_SAMPLE_SQL} FROM sharded""",
    "shard_verify_broken": f"""WITH {SHARD_CTE}
        SELECT printf('%s-%05d.tar', split, shard_idx) AS shard, shard_idx > 0 AS ok,
               CASE WHEN shard_idx = 0 THEN 'ReadError' END AS error
        FROM sharded GROUP BY split, shard_idx""",
    "shard_order": f"WITH {_ORDER_CTE} SELECT shard_idx, n, shard_rank, first_pos FROM shard_order",
    "block_shuffle": f"WITH {_BLOCK_CTE} SELECT sample_key, pos FROM blocks",
    "buffer_shuffle": f"""WITH {_ORDER_CTE},
        drawn AS (
            SELECT sample_key, first_pos + shard_pos AS pos, md5('{SEED}:{EPOCH}:' || sample_key) AS digest
            FROM sharded JOIN shard_order USING (shard_idx) WHERE split = 'train')
        SELECT sample_key, row_number() OVER (
                   ORDER BY pos + CAST('0x' || substr(digest, 1, 8) AS BIGINT) % {BUFFER}, digest, sample_key) - 1 AS pos
        FROM drawn""",
    "chunk_shuffle": f"WITH {_CHUNK_CTE} SELECT sample_key, pos FROM chunks",
    "train_batches": f"""WITH {_CHUNK_CTE}
        SELECT sample_key, pos // {BATCH} AS batch_id, CAST(pos % {BATCH} AS INTEGER) AS batch_pos
        FROM chunks WHERE pos // {BATCH} < (SELECT count(*) FROM chunks) // {BATCH}""",
    "val_batches": f"WITH {_VAL_CTE} SELECT sample_key, batch_id, batch_pos FROM val",
    "limit_val_batches": f"""WITH {_VAL_CTE}
        SELECT sample_key, batch_id FROM val WHERE batch_id < {LIMIT}""",
    "collated_batches": f"""WITH {_VAL_CTE}
        SELECT batch_id, CAST(count(*) AS INTEGER) AS n,
               string_agg(sample_key, ',' ORDER BY batch_pos) AS sample_keys
        FROM val GROUP BY batch_id""",
}
