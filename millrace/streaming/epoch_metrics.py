"""Validation figures of an epoch whose batches arrive one by one.

A micro-batch leaves partial counts, one row per batch, example and domain, in a folder of its
own; counts add up, so a figure is folded from whatever has arrived, in any order, and an
example or a batch may be spread over several arrivals. A replayed micro-batch overwrites its
folder. Folders that are folded together become one, which counts in their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import metrics
from millrace.session import delete_folder

STATE_SCHEMA = "batch_id bigint, example_id bigint, domain string, correct bigint, total bigint"
PARTS_SCHEMA = f"{STATE_SCHEMA}, first bigint, last bigint"


def partial_counts(pred: DataFrame, pad_id: int) -> DataFrame:
    """Hits and counted positions by batch, example and domain."""
    named = pred.withColumn("domain", F.coalesce("domain", F.lit(metrics.UNKNOWN_DOMAIN)))
    return named.groupBy("batch_id", "example_id", "domain").agg(*metrics.hit_counts(pad_id))


def start_epoch_sink(stream: DataFrame, out: str, pad_id: int, one_pass: bool = True) -> StreamingQuery:
    """Fold a stream of predictions into partial counts below ``<out>/parts``."""

    def process(batch: DataFrame, number: int) -> None:
        rows = partial_counts(batch, pad_id)
        rows.write.mode("overwrite").parquet(f"{out}/parts/first={number}/last={number}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{out}/log")
    if one_pass:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _parts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PARTS_SCHEMA).option("basePath", f"{out}/parts").parquet(f"{out}/parts")


def _counted(parts: DataFrame) -> list[tuple[int, int]]:
    """The ranges of micro-batches that count: none that lies within a longer one."""
    spans = sorted((tuple(r) for r in parts.select("first", "last").distinct().collect()), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for span in spans:
        if not out or span[1] > out[-1][1]:
            out.append(span)
    return out


def _state(spark: SparkSession, out: str) -> DataFrame:
    parts = _parts(spark, out)
    spans = parts.sparkSession.createDataFrame(_counted(parts) or [(-1, -1)], "first bigint, last bigint")
    rows = parts.join(F.broadcast(spans), ["first", "last"])
    return rows.groupBy("batch_id", "example_id", "domain").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def fold(spark: SparkSession, out: str) -> None:
    """Make the folders so far one. Until it is whole, it does not count; then they do not."""
    spans = _counted(_parts(spark, out))
    if len(spans) < 2:
        return
    first, last = spans[0][0], spans[-1][1]
    whole = f"{out}/work/{first}-{last}"
    _state(spark, out).write.mode("overwrite").parquet(whole)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = fs_path(f"{out}/parts/first={first}/last={last}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(fs_path(whole), target):
        raise OSError(f"cannot publish {target}")
    for a, b in spans:
        delete_folder(spark, f"{out}/parts/first={a}/last={b}")


def read_example_results(spark: SparkSession, out: str) -> DataFrame:
    rows = _state(spark, out)
    return rows.groupBy("example_id", "domain").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def read_batch_accuracy(spark: SparkSession, out: str) -> DataFrame:
    examples = _state(spark, out).groupBy("batch_id", "example_id").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return metrics.accuracy_of_batches(examples)


def read_domain_accuracy(spark: SparkSession, out: str) -> DataFrame:
    return metrics.domain_accuracy(_state(spark, out))


def read_domain_gap(spark: SparkSession, out: str, first: str, second: str) -> DataFrame:
    return metrics.domain_gap(_state(spark, out), first, second)
