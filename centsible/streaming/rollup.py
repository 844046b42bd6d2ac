"""Rollups of a stream for consumers that want them without the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from centsible.schemas import DAILY, MONEY, REVERSED, SETTLED, WEEKLY

# Windows count from 1970-01-01, a Thursday, so Monday weeks start four days later.
_WINDOWS = {DAILY: ("1 day", None), WEEKLY: ("7 days", "4 days")}
MEASURES = ["total_spend", "transaction_count", "total_reversed"]


def windowed_sums(transactions: DataFrame, period_type: str) -> DataFrame:
    """Spend, count and reversals per account, category and day or Monday week."""
    length, start = _WINDOWS[period_type]
    bucket = F.window("transacted_at", length, length, start) if start else F.window("transacted_at", length)
    settled = F.col("status") == SETTLED
    zero = F.lit(0).cast(MONEY)
    return (
        transactions.where(F.col("status").isin(SETTLED, REVERSED) & F.col("category_id").isNotNull())
        .groupBy("account_id", "category_id", bucket.alias("bucket"))
        .agg(
            F.sum(F.when(settled, F.col("amount")).otherwise(zero)).cast(MONEY).alias("total_spend"),
            F.count_if(settled).alias("transaction_count"),
            F.sum(F.when(settled, zero).otherwise(F.col("amount"))).cast(MONEY).alias("total_reversed"),
        )
        .select(
            "account_id",
            "category_id",
            F.to_date("bucket.start").alias("period_date"),
            F.lit(period_type).alias("period_type"),
            *MEASURES,
        )
    )


def start_windowed_rollup(
    transactions: DataFrame, period_type: str, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write each micro-batch's sums below its ``batch_id``.

    The sums add up, so there is no state, no watermark and no lateness: a row of any age lands in the part
    of the batch that brings it. Months have no fixed length and come from the rollup table instead.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        windowed_sums(batch, period_type).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = transactions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def windowed_rollup(parts: DataFrame) -> DataFrame:
    """The rollup as of all written parts."""
    keys = ["account_id", "category_id", "period_date", "period_type"]
    return parts.groupBy(*keys).agg(*[F.sum(m).cast(parts.schema[m].dataType).alias(m) for m in MEASURES])
