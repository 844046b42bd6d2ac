"""Sorting, top-k and offset pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centsible.session import scratch_path

DEFAULT_PAGE_SIZE = 20
#: Pages that end by this row are a top-k of so many rows at most.
SHALLOW = 5_000


class SortKey(NamedTuple):
    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()


class Page(NamedTuple):
    """``data`` holds the rows of the page in order, ``meta`` one row about the whole result."""

    data: DataFrame
    meta: DataFrame


def sort_keys(allowed: Mapping[str, str], order: str, direction: str, tie_break: str) -> list[SortKey]:
    """Sort by an allow-listed column, then by a unique column so that pages never overlap."""
    if order not in allowed:
        raise ValueError(f"order must be one of {sorted(allowed)}, got {order!r}")
    if direction.lower() not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, got {direction!r}")
    return [SortKey(allowed[order], direction.lower() == "desc"), SortKey(tie_break)]


def sorted_by(df: DataFrame, keys: list[SortKey]) -> DataFrame:
    return df.orderBy(*[key.column for key in keys])


def take_page(df: DataFrame, keys: list[SortKey], page: int, size: int) -> DataFrame:
    """Rows ``page * size`` up to ``(page + 1) * size`` of the sorted rows; pages start at 0.

    A page that ends within the first ``SHALLOW`` rows is a top-k, which reads the input once and keeps so many rows a task.
    Beyond that only the sort keys are sorted. They are range-partitioned and written to the shared folder (counting
    and reading must see the same ranges); the ranges' running counts give the place of each range, only
    ranges that overlap the page are numbered, and the rows of the page are then picked by
    their keys, at most ``size``. So no task holds what lies before the page, at any depth. The keys together
    must be unique.
    """
    if page < 0 or size < 1:
        raise ValueError("page must be >= 0 and size >= 1")
    if (page + 1) * size <= SHALLOW or page == 0:
        return sorted_by(df, keys).offset(page * size).limit(size)
    skip, names, columns = page * size, [key.name for key in keys], [key.column for key in keys]
    path = scratch_path(df.sparkSession, "sort-keys")
    ranged = df.select(*names).repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = sizes.withColumn("_start", before).where(
        (F.col("_start") < skip + size) & (F.col("_start") + F.col("_rows") > skip)
    )
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*columns)) - 1
    picked = (
        ranged.join(starts.select("_part", "_start"), "_part")
        .withColumn("_place", place)
        .where((F.col("_place") >= skip) & (F.col("_place") < skip + size))
        .select(*[F.col(name).alias(f"_{name}") for name in names])
    )
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names))
    return sorted_by(df.join(picked, same, "left_semi"), keys)


def take_after(df: DataFrame, keys: list[SortKey], after: Sequence | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row with the key values ``after`` (None: from the start).

    A filter that reaches the scan and a top-k: every page costs the same. Sort values must not be null.
    """
    if size < 1:
        raise ValueError("size must be >= 1")
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"{len(keys)} key values needed, got {len(after)}")
        beyond, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after):
            column = F.col(key.name)
            beyond = beyond | (equal & (column < F.lit(value) if key.descending else column > F.lit(value)))
            equal = equal & (column == F.lit(value))
        # the bound on the first key alone can be pushed to the scan
        first = F.col(keys[0].name)
        bound = first <= F.lit(after[0]) if keys[0].descending else first >= F.lit(after[0])
        df = df.where(bound).where(beyond)
    return sorted_by(df, keys).limit(size)


def page_meta(df: DataFrame, page: int, size: int) -> DataFrame:
    """Total rows, number of pages and whether more follow; filled for any page number."""
    total = F.col("total_count")
    pages = F.ceil(total / F.lit(size)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count",
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page + 1) < pages).alias("has_more"),
    )


def top_k(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k)
