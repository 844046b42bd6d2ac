"""Queries over the rollup table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.schemas import DAILY, TOTAL


def select_rollup(
    rollup: DataFrame,
    account_id: str | None = None,
    period_type: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Rollup rows of one account (or all), one period type (or all) and a closed date range."""
    if account_id is not None:
        account = F.col("account_id")
        rollup = rollup.where((account == account_id) | account.isNull())
    if period_type is not None:
        rollup = rollup.where(F.col("period_type") == period_type)
    if date_from is not None:
        rollup = rollup.where(F.col("period_date") >= F.lit(date_from))
    if date_to is not None:
        rollup = rollup.where(F.col("period_date") <= F.lit(date_to))
    return rollup


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).cast(TOTAL).alias(column)


def _count():
    return F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("transaction_count")


def category_summary(
    rollup: DataFrame,
    categories: DataFrame,
    account_id: str | None = None,
    period_type: str = DAILY,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Spend, count and reversals per category, largest spend first.

    The names are joined after the aggregation, to one row per category.
    """
    names = categories.select(
        F.col("id").alias("category_id"),
        F.col("code").alias("category_code"),
        F.col("label").alias("category_label"),
    )
    return (
        select_rollup(rollup, account_id, period_type, date_from, date_to)
        .groupBy("category_id")
        .agg(_total("total_spend"), _count(), _total("total_reversed"))
        .join(names, "category_id", "left")  # spend in an unknown category stays, without a name
        .select("category_code", "category_label", "total_spend", "transaction_count", "total_reversed")
        .orderBy(F.col("total_spend").desc(), F.col("category_code").asc())
    )


def by_category(
    rollup: DataFrame,
    categories: DataFrame,
    account_id: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Spend by category over any dates; daily rows only, so nothing is counted twice."""
    return category_summary(rollup, categories, account_id, DAILY, date_from, date_to)


def time_series(
    rollup: DataFrame,
    account_id: str | None = None,
    period_type: str = DAILY,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Spend and count per period, oldest first."""
    return (
        select_rollup(rollup, account_id, period_type, date_from, date_to)
        .groupBy("period_date")
        .agg(_total("total_spend"), _count())
        .orderBy("period_date")
    )
