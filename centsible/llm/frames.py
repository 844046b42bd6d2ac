"""Small DataFrame helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from centsible.session import scratch_path

BATCH_BYTES = "8m"
MOST_PIECES = 1 << 16
PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, wherever their Python starts: Spark serves it to them once."""
    context = spark.sparkContext
    if getattr(context, "_centsible_shipped", False):
        return
    # a file of the driver alone; Spark copies it to the executors itself
    target = os.path.join(tempfile.mkdtemp(prefix="centsible-"), "centsible.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._centsible_shipped = True


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, in batches of bounded size: a batch ends after so
    many bytes or rows, whichever comes first, so long texts do not add up in a worker."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, readable after any executor is lost."""
    return written_at(df, name, *partition_by)[0]


def written_at(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """The same and where it is, to be removed once nothing reads it."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written_counted(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, tuple]:
    """The same, and aggregates of its rows, taken while they are written: no job of their own."""
    seen = Observation()
    names = [f"c{n}" for n in range(len(counts))]
    table = written(df.observe(seen, *[c.alias(n) for c, n in zip(counts, names)]), name)
    return table, tuple(seen.get[n] for n in names)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads; what has no known size counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(n).stats().sizeInBytes()) for n in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)


def pieces_for(df: DataFrame, piece_bytes: int = 64 << 20) -> int:
    """How many pieces of about so many bytes the input of a frame has, but at least as many as the session's
    shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-input_bytes(df) // piece_bytes), MOST_PIECES))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """The same, bucketed by a key: joins on it do not shuffle this side again. With the name of its catalog
    entry, to be dropped after use."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = path.rpartition("/")[2].replace("-", "_")
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table_name)
    return spark.table(table_name), table_name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of the given names (in any case): room for those that an operator adds."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


OWN = "own_columns"


def set_aside(df: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others inside one, where their names clash with nothing."""
    others = [df[c].alias(c) for c in df.columns if c not in used]
    return df.select(*used, (F.struct(*others) if others else F.lit(None).cast("int")).alias(OWN))


def brought_back(df: DataFrame, original: DataFrame, *used: str) -> list[Column]:
    """The columns of the original of a frame made by ``set_aside``, in their order."""
    return [df[c] if c in used else df[OWN].getField(c).alias(c) for c in original.columns]


def text_id() -> Column:
    """64 bits of the whole text; with doc_id it tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys ends, of rows sorted by keys.

    Each table holds whole groups, as many as one batch completes. Only the last group of a batch
    waits for the next one.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for values in key:
            change[1:] |= values[1:] != values[:-1]
        first = tuple(values[0] for values in key)
        if waiting:
            last = waiting[-1]
            before = tuple(last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() for k in keys)
            if before != first:
                yield pa.Table.from_batches(waiting)
                waiting = []
        cut = np.flatnonzero(change)
        if len(cut):
            yield pa.Table.from_batches([*waiting, batch.slice(0, int(cut[-1]))])
            waiting = [batch.slice(int(cut[-1]))]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def quantile_cuts(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Cut points that split a whole-number column into about so many ranges of equally many rows."""
    if parts < 2:
        return []
    shares = [n / parts for n in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(column, shares, max(10_000, 10 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))
