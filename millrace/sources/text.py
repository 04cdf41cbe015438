"""Reading raw text sources and exchanging examples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import SourceSpec
from millrace.functions.cleaning import CLEANERS
from millrace.operators.quota import Source

CORRUPT = "_unread"
EXAMPLE_SCHEMA = "id string, domain string, text string, pos bigint"


def read_source(spark: SparkSession, spec: SourceSpec) -> Source:
    """Source described by ``spec``, reduced to its sort key and its text.

    A table without the named columns is an error. JSON records may lack the text
    (it is null then), but a record in which a sort key cannot be read as its type
    ends the query.
    """
    reader = spark.read.format(spec.format)
    if spec.format == "json":
        types = spec.key_types or ["bigint"] * len(spec.order)
        keys = ", ".join(f"`{c}` {t}" for c, t in zip(spec.order, types, strict=True))
        reader = reader.schema(f"{keys}, `{spec.text}` string, `{CORRUPT}` string")
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.load(spec.path)
    missing = [c for c in spec.order if c not in rows.columns]
    if missing:
        raise ValueError(f"source {spec.domain} lacks its sort key {missing}")
    if spec.text not in rows.columns:
        raise ValueError(f"source {spec.domain} has no text column {spec.text!r}: {rows.columns}")
    columns = [F.col(f"`{c}`") for c in (*spec.order, spec.text)]
    if spec.format == "json":
        unread = F.col(CORRUPT).isNotNull()
        said = F.concat(F.lit(f"source {spec.domain}: a record does not fit its schema: "), F.col(CORRUPT))
        columns = [
            F.when(unread, F.raise_error(said).cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
            for c in spec.order
        ] + columns[-1:]
    return Source(spec.domain, rows.select(*columns), spec.order, CLEANERS[spec.cleaner], spec.text)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8; null fields are left out."""
    df.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
