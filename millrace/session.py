"""Session helpers: a local builder, package shipping, shared scratch space."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "millrace", **conf: str) -> SparkSession:
    """Session for one machine; on a cluster the session comes from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._millrace_shipped = True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work on a small scan a task per core at least.

    A scan with fewer partitions than cores (few files, or one row group) is
    redistributed by ``keys``; a large scan is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the checkpoint folder of the configuration
    or, failing that, of the running context.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local one would vanish with its machine.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        # A folder set on the running context.
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = chosen.get() if chosen.isDefined() else None
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_scratch"):
        sc._millrace_scratch = tempfile.mkdtemp(prefix="millrace-scratch-")
    return sc._millrace_scratch


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """Fresh path below the shared folder."""
    return f"{scratch_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote, in any store Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_dropping: dict[str, list] = {}
_dropping_lock = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let queries started here delete their shuffle files when they end, not when the driver
    happens to collect its garbage. The session's setting is put back by the last one out."""
    key = spark.sparkContext.applicationId + str(spark._jsparkSession.sessionUUID())
    with _dropping_lock:
        users = _dropping.setdefault(key, [0, spark.conf.get(CLEANUP_KEY, None)])
        users[0] += 1
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        with _dropping_lock:
            users[0] -= 1
            if not users[0]:
                del _dropping[key]
                if users[1] is None:
                    spark.conf.unset(CLEANUP_KEY)
                else:
                    spark.conf.set(CLEANUP_KEY, users[1])


def pin(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``unpin`` deletes it.

    Cuts lineage with a table that outlives lost executors, freezes values that
    depend on the physical layout, keeps column pruning for later readers, and
    gives the optimizer a real size, so it broadcasts the table in a join only
    if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._pinned_at = path
    return table


def unpin(*tables: DataFrame) -> None:
    """Delete tables that ``pin`` wrote, once what is made of them has been written too."""
    for table in tables:
        delete_folder(table.sparkSession, table._pinned_at)
