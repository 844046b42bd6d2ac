"""Key index: which keys were seen, and when, in bucketed parts.

Every batch leaves one part, hashed by key into buckets and sorted within them. To look keys up, the parts of a level are opened as one
bucketed table: the join with a batch shuffles the batch only, and a batch of few keys reads only their buckets, and of
these only row groups whose Bloom filter may hold them. Parts are merged bucket by bucket, without a
shuffle; each level has more buckets than the one below, so a bucket does not grow with the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centsible.session import scratch_path

FIRST_BUCKETS, MOST_BUCKETS = 8, 8192
#: So many keys are looked up one by one, instead of by a join.
FEW = 500
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"}


def buckets(level: int, fan: int) -> int:
    return min(FIRST_BUCKETS * fan**level, MOST_BUCKETS)


def write_keys(rows: DataFrame, path: str, level: int, fan: int) -> None:
    """Rows (key, seen_at) as a part. Rows that come from a level below are in order already and not shuffled."""
    n, name = buckets(level, fan), f"keys_{uuid.uuid4().hex}"
    dealt = rows.repartition(n, "key") if level == 0 else rows
    dealt.write.bucketBy(n, "key").sortBy("key").options(**BLOOM).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay


@contextmanager
def opened(spark: SparkSession, paths: Iterable[str], level: int, fan: int) -> Iterator[DataFrame]:
    """Parts of one level as a bucketed table (key, seen_at) while the context lasts."""
    name = f"keys_{uuid.uuid4().hex}"
    place = scratch_path(spark, "keys")  # of the table itself, which has no rows outside its parts
    spark.sql(
        f"""CREATE TABLE {name} (key STRING, seen_at TIMESTAMP, part INT) USING parquet PARTITIONED BY (part)
        CLUSTERED BY (key) SORTED BY (key) INTO {buckets(level, fan)} BUCKETS LOCATION '{place}'"""
    )
    try:
        parts = " ".join(f"PARTITION (part = {n}) LOCATION '{path}'" for n, path in enumerate(paths))
        spark.sql(f"ALTER TABLE {name} ADD {parts}")
        yield spark.table(name).select("key", "seen_at")
    finally:
        spark.sql(f"DROP TABLE {name}")


def merge_keys(spark: SparkSession, paths: list[str], path: str, level: int, fan: int) -> None:
    """Parts of a level as one part of the next, each key with the time it was last seen."""
    with opened(spark, paths, level, fan) as rows:
        write_keys(rows.groupBy("key").agg(F.max("seen_at").alias("seen_at")), path, level + 1, fan)


def known_keys(keys: DataFrame, parts: dict[int, list[str]], fan: int, since=None, place: str | None = None) -> DataFrame:
    """Those of the distinct ``keys`` (a stored table with one column, key) that parts (by level) hold; with ``since``
    those seen after that time. The result is a table of at most as many rows, below ``place`` if that is given."""
    spark = keys.sparkSession
    few = [r.key for r in keys.limit(FEW + 1).collect()]  # at most so many rows
    found, hits = [], set()
    for level, paths in sorted(parts.items()):
        with opened(spark, paths, level, fan) as rows:
            if since is not None:
                rows = rows.where(F.col("seen_at") > F.lit(since))
            if len(few) <= FEW:
                hits |= {r.key for r in rows.where(F.col("key").isin(few)).select("key").distinct().collect()}
            else:
                path = f"{place}-level{level}" if place else scratch_path(spark, "known")
                rows.select("key").join(keys, "key", "left_semi").distinct().write.parquet(path)
                found.append(path)
    if found:
        return spark.read.schema("key string").parquet(*found).distinct()
    return spark.createDataFrame([(key,) for key in sorted(hits)], "key string")
