"""Stored stages: build once, reuse while the configuration is the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "stage string, split string, rows bigint, shards bigint"


def input_snapshot(spark: SparkSession, path: str) -> str:
    """Number, size, and a digest of names, sizes and times of the files below ``path``.

    Spark lists them, and their contents are not read; the digest does not depend on order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    found = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(each)).first()
    return ":".join(str(v) for v in found)


@dataclass(frozen=True)
class StageStore:
    """Tables below ``<base>/<fingerprint>/<stage>``, with a manifest of exact
    row and shard counts next to them."""

    spark: SparkSession
    base: str
    fingerprint: str

    @property
    def root(self) -> str:
        return f"{self.base.rstrip('/')}/{self.fingerprint}"

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def exists(self, stage: str) -> bool:
        """True once the stage has been written to its end."""
        return self._written(self.path(stage))

    def _written(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return marker.getFileSystem(conf).exists(marker)

    def get(
        self,
        stage: str,
        build: Callable[[], DataFrame],
        partition_by: Sequence[str] = (),
        file_format: str = "parquet",
    ) -> DataFrame:
        """The stored stage, built and written first if it is not there. If only its
        counts are missing (a crash between the two writes), they are taken again."""
        if not self.exists(stage):
            writer = build().write.mode("overwrite").partitionBy(*partition_by)
            writer.format(file_format).save(self.path(stage))
            self._record(stage, file_format)
        elif not self._written(f"{self.root}/manifest/part={stage}"):
            self._record(stage, file_format)
        return self.read(stage, file_format)

    def read(self, stage: str, file_format: str = "parquet") -> DataFrame:
        return self.spark.read.format(file_format).load(self.path(stage))

    def _record(self, stage: str, file_format: str) -> None:
        df = self.read(stage, file_format)
        split = F.col("split") if "split" in df.columns else F.lit(None).cast("string")
        shards = F.max("shard_idx") + 1 if "shard_idx" in df.columns else F.lit(None)
        counts = df.groupBy(split.alias("split")).agg(
            F.count(F.lit(1)).alias("rows"), shards.cast("bigint").alias("shards")
        )
        counts.select(F.lit(stage).alias("stage"), "split", "rows", "shards").coalesce(
            1
        ).write.mode("overwrite").json(f"{self.root}/manifest/part={stage}")

    def manifest(self) -> DataFrame:
        """``(stage, split, rows, shards)`` of every stored stage."""
        return (
            self.spark.read.schema(MANIFEST_SCHEMA)
            .option("recursiveFileLookup", "true")
            .json(f"{self.root}/manifest")
        )

    def length(self, stage: str, split: str | None = None) -> int:
        """Declared number of rows of a stage or of one of its splits."""
        rows = self.manifest().filter(F.col("stage") == stage)
        if split is not None:
            rows = rows.filter(F.col("split") == split)
        found = rows.agg(F.sum("rows")).first()[0]
        if found is None:
            raise ValueError(f"stage {stage!r} (split {split!r}) has not been written")
        return found
