"""Daily, weekly and monthly spend and reversal rollups per account and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.functions.periods import period_start
from centsible.schemas import DAILY, MONEY, PERIOD_TYPES, REVERSED, ROLLUP_KEYS, ROLLUP_SCHEMA, SETTLED

_DAILY_KEYS = ["account_id", "category_id", "period_date"]


def _measures(updated_at: Column) -> list[Column]:
    """All measures add up, so partial rollups can be merged in any order."""
    return [
        F.sum("total_spend").cast(MONEY).alias("total_spend"),
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("total_reversed").cast(MONEY).alias("total_reversed"),
        F.max(updated_at).alias("updated_at"),
    ]


def daily_rollup(transactions: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """One row per account, category and UTC day.

    Settled rows add to spend and count, reversed rows to the reversed total only; pending
    and uncategorised-null rows add nothing. ``updated_at`` defaults to the latest arrival.
    """
    settled = F.col("status") == SETTLED
    zero = F.lit(0).cast(MONEY)
    counted = transactions.where(
        F.col("status").isin(SETTLED, REVERSED) & F.col("category_id").isNotNull()
    ).select(
        "account_id",
        "category_id",
        F.to_date("transacted_at").alias("period_date"),
        F.when(settled, F.col("amount")).otherwise(zero).alias("total_spend"),
        F.when(settled, 1).otherwise(0).cast("bigint").alias("transaction_count"),
        F.when(settled, zero).otherwise(F.col("amount")).alias("total_reversed"),
        (F.col("created_at") if updated_at is None else updated_at).alias("updated_at"),
    )
    return counted.groupBy(*_DAILY_KEYS).agg(*_measures(F.col("updated_at")))


def expand_periods(daily: DataFrame, period_types: Sequence[str] = PERIOD_TYPES) -> DataFrame:
    """Daily rows -> rollup rows of the asked period types.

    Weeks and months are summed from the days, not from the transactions again. Daily rows
    are final already and skip that second aggregation.
    """
    parts = []
    if DAILY in period_types:
        parts.append(daily.withColumn("period_type", F.lit(DAILY)))
    longer = [p for p in period_types if p != DAILY]
    if longer:
        buckets = F.array(
            *[
                F.struct(F.lit(p).alias("period_type"), period_start(F.col("period_date"), p).alias("period_date"))
                for p in longer
            ]
        )
        parts.append(
            daily.select("*", F.inline(buckets).alias("period_type", "bucket_date"))
            .drop("period_date")
            .withColumnRenamed("bucket_date", "period_date")
            .groupBy(*ROLLUP_KEYS)
            .agg(*_measures(F.col("updated_at")))
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(*ROLLUP_SCHEMA.names)


def rollup(
    transactions: DataFrame,
    period_types: Sequence[str] = PERIOD_TYPES,
    updated_at: Column | None = None,
) -> DataFrame:
    """The whole rollup table, recomputed from the transactions."""
    return expand_periods(daily_rollup(transactions, updated_at), period_types)


def merge_daily(parts: DataFrame) -> DataFrame:
    """Add up the daily shares that several batches left behind."""
    return parts.groupBy(*_DAILY_KEYS).agg(*_measures(F.col("updated_at")))


def merge_rollups(*rollups: DataFrame) -> DataFrame:
    """Add up rollup tables, e.g. a compacted base and the batches since."""
    merged = rollups[0].select(*ROLLUP_SCHEMA.names)
    for other in rollups[1:]:
        merged = merged.unionByName(other.select(*ROLLUP_SCHEMA.names))
    return merged.groupBy(*ROLLUP_KEYS).agg(*_measures(F.col("updated_at"))).select(*ROLLUP_SCHEMA.names)
