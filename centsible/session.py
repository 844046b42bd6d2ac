"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job needs; all can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A finished query's shuffle files go at once, not when the driver's garbage collector gets to them.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Streaming dedup state lives in RocksDB, outside the executor heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# Settings of the ingest and its tables, where nobody set others.
INGEST_CONF = {
    # Packed records grow tenfold when they are read; the rows of a piece of this size are sorted in memory.
    "spark.sql.files.maxPartitionBytes": "65536k",
}

#: Options of stored rows. Payloads and events are texts that say the same words again and again; packed they are a tenth, so row
#: groups, the least that a task reads, are small. A higher level packs them no better.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(64 << 20)}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PIECES_PER_CORE = 8


def build_session(app_name: str = "centsible", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession, ingest: bool = True) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere; without ``ingest`` those of the ingest are left out, or taken back."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    given = spark.conf.getAll
    for key, value in INGEST_CONF.items():
        if ingest and key not in given:
            spark.conf.set(key, value)
        elif not ingest and given.get(key) == value:
            spark.conf.unset(key)
    cores = spark.sparkContext.defaultParallelism
    if "spark.sql.shuffle.partitions" not in spark.conf.getAll:
        # not set by anyone, to whatever number: one state partition per core for streams, and for batches several
        # pieces per core, which adaptive execution merges to its advisory size
        spark.conf.set("spark.sql.shuffle.partitions", str(cores))
        if spark.conf.get(INITIAL_PARTITIONS, None) is None:
            spark.conf.set(INITIAL_PARTITIONS, str(PIECES_PER_CORE * cores))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session may
    fall back to a temporary folder, because there driver and executors share a disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="centsible-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while the context lasts."""
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
