"""Corpus preparation from raw sources to verified shards and batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import CorpusConfig
from millrace.operators.batching import with_batches
from millrace.operators.quota import number_sources
from millrace.operators.reports import attribution, domain_stats
from millrace.operators.sharding import shuffled_fragments
from millrace.operators.shuffling import (
    block_shuffle,
    chunk_shuffle,
    read_positions,
    seeded_shuffle,
)
from millrace.operators.splitting import TRAIN, VALIDATION, stratified_split
from millrace.operators.tokenizing import encode_hash
from millrace.sources.stages import StageStore, input_snapshot
from millrace.sources.tar_shards import verify_shards, write_shards
from millrace.sources.text import read_source


@dataclass(frozen=True)
class PreparedCorpus:
    """Stored stages and the readers over them."""

    spark: SparkSession
    config: CorpusConfig
    store: StageStore
    clean: DataFrame

    @property
    def attribution(self) -> DataFrame:
        return self.store.read("attribution", "json")

    @property
    def split(self) -> DataFrame:
        return self.store.read("split")

    @property
    def fragments(self) -> DataFrame:
        return self.store.read("fragments")

    def shuffled(self) -> DataFrame:
        """The clean table with its seeded order. The split orders rows by a
        hash of their own, so this order is derived on demand only."""
        return seeded_shuffle(self.clean, self.config.seed)

    def domain_stats(self) -> DataFrame:
        return domain_stats(self.split)

    def length(self, split: str) -> int:
        return self.store.length("fragments", split)

    def train_batches(self, epoch: int = 0) -> DataFrame:
        """Shuffled fragments with ``batch_id``; a short last batch is dropped.

        Reading positions come from a table of one row per shard; the rows move once,
        to their block, and chunks are placed by a table that does not need them.
        """
        cfg = self.config
        rows = self.fragments.filter(F.col("split") == TRAIN)
        n = self.length(TRAIN)
        order = read_positions(rows, cfg.seed, epoch)
        order = block_shuffle(order, cfg.seed, epoch, "sample_key", max(cfg.shuffle_buffer // 2, 1))
        order = chunk_shuffle(order, cfg.seed, epoch, n)
        return with_batches(order, cfg.batch_size, drop_last=True, rows=n)

    def validation_batches(self) -> DataFrame:
        """Fragments in stored order with ``batch_id``; all rows are kept."""
        cfg = self.config
        rows = self.fragments.filter(F.col("split") == VALIDATION)
        pos = F.col("shard_idx").cast("bigint") * cfg.shard_size + F.col("shard_pos")
        return with_batches(rows.withColumn("pos", pos), cfg.batch_size, drop_last=False)

    def export_tar(self, path: str) -> DataFrame:
        """Write both splits as tar shards below ``path`` and verify them."""
        for split in (TRAIN, VALIDATION):
            write_shards(self.fragments.filter(F.col("split") == split), path, split)
        return verify_shards(self.spark, path)


def prepare_corpus(
    spark: SparkSession,
    config: CorpusConfig,
    processing_date: str,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> PreparedCorpus:
    """Clean, take quotas, split, tokenise and shard, reusing stored stages of the same
    configuration over the same input files.

    The cleaned texts are written once. Ids, order and split are narrow tables of row
    numbers; a text is fetched by its number when its tokens are made. ``encode`` maps a table with ``text`` to the same table with ``ids``; the
    default is the hash vocabulary.
    """
    inputs = [input_snapshot(spark, s.path) for s in config.sources]
    store = StageStore(spark, config.base_path, config.fingerprint(inputs))
    if (encode is None) != (config.tokenizer == "hash"):
        raise ValueError("name the tokenizer in the configuration if and only if you supply it")
    encode = encode or (lambda df: encode_hash(df, config.vocab_size))

    def save(rows: DataFrame, stage: str) -> DataFrame:
        return store.get(stage, lambda: rows)

    sources = [read_source(spark, s) for s in config.sources]
    numbered = number_sources(sources, config.quotas(), config.min_words_exclusive, save)
    index = numbered.index

    def about() -> DataFrame:
        labels = {s.domain: s.label or s.domain for s in config.sources}
        return attribution(
            index, config.attribution, labels, config.min_words_exclusive, processing_date
        )

    store.get("attribution", about, file_format="json")

    def split() -> DataFrame:
        return stratified_split(index, config.val_ratio, config.seed)

    parts = store.get("split", split, ["split"])
    tokens = store.get(
        "tokens",
        lambda: encode(numbered.texts.join(parts, ["domain", "_row"]).select("id", "domain", "split", "text"))
        .drop("text")
        .withColumn("n_tokens", F.size("ids")),
        ["split"],
    )
    store.get(
        "fragments",
        lambda: shuffled_fragments(
            tokens, config.seed, config.window, config.stride, config.pad_id, config.shard_size
        ),
        ["split"],
    )
    return PreparedCorpus(spark, config, store, numbered.join())
