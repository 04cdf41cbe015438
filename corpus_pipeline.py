"""From raw documents to token files: the stages of the corpus pipeline.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and reread as the next one's docs.

Of every stage: an empty table gives an empty table; texts are read whole, however long; all
columns but the last stage's come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, near_copies, quality, token_files
from millrace.session import pin, ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go. Null and empty texts are scored like any other
    (all statistics zero); copies share their fate; without labels all documents stay."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles the smallest doc_id
    stays: of several rows with it any one, null ids last. Texts without words, null ones too, are
    one group; a text of fewer than five words is one shingle."""
    ship_package(spark)
    return near_copies.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go; so does a document that is little else. Null and empty texts
    have no passages and stay; copies are cut alike; ``n_chars`` follows a text that was cut."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: equal rows of one source are told apart
    arbitrarily, a null source is a source, null and empty texts have size 0 and cost nothing."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a file, and what the file says of every document: a null or empty text is the
    end id alone, a document taken twice is there twice, null ids come first."""
    ship_package(spark)
    return token_files.encode_corpus(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("source mixing", mix_sources),
    ("token-id output", write_token_files),
]

ORACLE_SQL = None  # models, fingerprints and token files, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
