"""Incremental cleaning with running quotas and ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.cleaning import clean_and_keep
from millrace.operators.ranking import index_from_place, write_in_order
from millrace.session import delete_folder

COUNT_SCHEMA = "upto bigint, seen bigint, kept bigint, written bigint"
PROGRESS = "progress"


def cleaned_stream(
    stream: DataFrame,
    cleaner: Callable[[Column], Column],
    min_words_exclusive: int = 10,
    text: str = "text",
) -> DataFrame:
    """The batch cleaning expressions on a stream, with the number of rows seen
    and of rows kept observed under ``progress`` for each micro-batch."""
    seen = stream.observe(PROGRESS + "_seen", F.count(F.lit(1)).alias("rows"))
    kept = clean_and_keep(seen, cleaner, min_words_exclusive, text)
    return kept.observe(PROGRESS + "_kept", F.count(F.lit(1)).alias("rows"))


def start_numbered_sink(
    stream: DataFrame,
    cleaner: Callable[[Column], Column],
    domain: str,
    order: Sequence[str],
    out: str,
    quota: int | None = None,
    min_words_exclusive: int = 10,
    text: str = "text",
    one_pass: bool = True,
) -> StreamingQuery:
    """Clean the raw ``stream`` and write ``(id, domain, text, idx)`` to ``<out>/rows``,
    ids running on from batch to batch in arrival order and ``order`` within a batch, ties
    arbitrarily; ``quota`` bounds their number, and once it is met, batches are passed over
    unread.

    A batch is cleaned in one pass into a table of its own, which is then put in order; what
    it needs for that lies below ``<out>/work`` and goes when it is done. A batch owns
    one folder of rows and one with its counts, both overwritten when it is replayed, and
    starts from the count of the batch before it: a batch run twice gives the same ids.
    """
    spark = stream.sparkSession

    def offset_before(batch_id: int) -> int:
        if batch_id == 0:
            return 0
        return spark.read.schema(COUNT_SCHEMA).json(f"{out}/counts/batch={batch_id - 1}").first()["upto"]

    def numbered(batch: DataFrame, batch_id: int, start: int, left: int | None) -> tuple[int, int, int]:
        work, rows = f"{out}/work/batch={batch_id}", f"{out}/rows/batch={batch_id}"

        def save(df: DataFrame, label: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{label}")
            return spark.read.schema(df.schema).parquet(f"{work}/{label}")

        seen = Observation()
        raw = batch.select(*order, text).observe(seen, F.count(F.lit(1)).alias("rows"))
        kept = save(clean_and_keep(raw, cleaner, min_words_exclusive, text), "kept")
        indexed = index_from_place(write_in_order(kept, order, label="ordered", save=save), save=save)
        if left is not None:
            indexed = indexed.filter(F.col("idx") < left)
        indexed.select(
            F.concat(F.lit(f"{domain}_"), (F.col("idx") + start).cast("string")).alias("id"),
            F.lit(domain).alias("domain"),
            F.col(text).alias("text"),
            (F.col("idx") + start).alias("idx"),
        ).write.mode("overwrite").parquet(rows)
        counts = seen.get["rows"], kept.count(), spark.read.parquet(rows).count()
        delete_folder(spark, work)
        return counts

    def process(batch: DataFrame, batch_id: int) -> None:
        start = offset_before(batch_id)
        left = None if quota is None else max(quota - start, 0)
        counts = (0, 0, 0) if left == 0 else numbered(batch, batch_id, start, left)
        row = [(start + counts[2], *counts)]
        spark.createDataFrame(row, COUNT_SCHEMA).write.mode("overwrite").json(f"{out}/counts/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{out}/log")
    if one_pass:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """Per batch the rows read, kept by the filter, and written; zeros for a batch that
    was passed over."""
    return spark.read.schema(f"{COUNT_SCHEMA}, batch int").json(f"{out}/counts").select(
        "batch", "seen", "kept", "written"
    )


def read_numbered(spark: SparkSession, out: str) -> DataFrame:
    """Everything the sink has written so far."""
    return spark.read.schema(
        "id string, domain string, text string, idx bigint, batch int"
    ).parquet(f"{out}/rows")
