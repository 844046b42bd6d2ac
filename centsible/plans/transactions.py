"""Queries over the transactions table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.functions.text import contains_ignore_case
from centsible.operators.categorise import with_category
from centsible.operators.paging import (
    DEFAULT_PAGE_SIZE,
    Page,
    page_meta,
    sort_keys,
    sorted_by,
    take_after,
    take_page,
    top_k,
)
from centsible.schemas import TOTAL

# Public sort names.
TRANSACTION_ORDER = {
    "createdAt": "created_at",
    "amount": "amount",
    "merchantName": "merchant_name",
}

OUTPUT = [
    "external_id",
    "source_id",
    "source_type",
    "account_id",
    "amount",
    "currency",
    "merchant_name",
    "merchant_mcc",
    "transacted_at",
    "status",
    "category_external_id",
    "category_code",
    "category_label",
    "category_tier",
    "created_at",
]

FEW_NAMES = 200


def in_date_range(
    df: DataFrame, time_col: str, date_from: date | None, date_to: date | None
) -> DataFrame:
    """Rows of the days ``date_from`` to ``date_to``, both included, either left open.

    A range on ``transacted_at`` also names the partition column, so other days are not read.
    """
    at = F.col(time_col)
    prune = time_col == "transacted_at" and "transacted_date" in df.columns
    if date_from is not None:
        df = df.where(at >= F.lit(date_from).cast("timestamp"))
        df = df.where(F.col("transacted_date") >= F.lit(date_from)) if prune else df
    if date_to is not None:
        df = df.where(at < F.lit(date_to + timedelta(days=1)).cast("timestamp"))
        df = df.where(F.col("transacted_date") <= F.lit(date_to)) if prune else df
    return df


def select_transactions(
    transactions: DataFrame,
    account_id: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    time_col: str = "created_at",
) -> DataFrame:
    """Filters that are left out are not applied."""
    if account_id is not None:
        transactions = transactions.where(F.col("account_id") == account_id)
    if status is not None:
        transactions = transactions.where(F.col("status") == status)
    return in_date_range(transactions, time_col, date_from, date_to)


def project(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Output form of transactions, with their category."""
    return with_category(transactions, categories).select(*OUTPUT)


def _page_of(
    matching: DataFrame, categories: DataFrame, page: int, page_size: int, order: str, direction: str
) -> Page:
    keys = sort_keys(TRANSACTION_ORDER, order, direction, "source_id")
    rows = take_page(matching, keys, page, page_size)
    # the category is joined to the page only
    return Page(sorted_by(project(rows, categories), keys), page_meta(matching, page, page_size))


def list_transactions(
    transactions: DataFrame,
    categories: DataFrame,
    account_id: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    page: int = 0,
    page_size: int = DEFAULT_PAGE_SIZE,
    order: str = "createdAt",
    direction: str = "asc",
    time_col: str = "created_at",
) -> Page:
    matching = select_transactions(transactions, account_id, status, date_from, date_to, time_col)
    return _page_of(matching, categories, page, page_size, order, direction)


def list_transactions_after(
    transactions: DataFrame,
    categories: DataFrame,
    after: tuple | None = None,
    page_size: int = DEFAULT_PAGE_SIZE,
    order: str = "createdAt",
    direction: str = "asc",
    account_id: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    time_col: str = "created_at",
) -> DataFrame:
    """The page after the row with ``after`` = (sort value, source_id); costs the same at any depth."""
    matching = select_transactions(transactions, account_id, status, date_from, date_to, time_col)
    keys = sort_keys(TRANSACTION_ORDER, order, direction, "source_id")
    return sorted_by(project(take_after(matching, keys, after, page_size), categories), keys)


def merchant_search(
    transactions: DataFrame,
    categories: DataFrame,
    name: str,
    date_from: date | None = None,
    date_to: date | None = None,
    page: int = 0,
    page_size: int = DEFAULT_PAGE_SIZE,
    order: str = "createdAt",
    direction: str = "asc",
    time_col: str = "created_at",
    names: DataFrame | None = None,
) -> Page:
    """Transactions whose merchant name contains the text, in any case. ``names`` are the distinct names that do, as
    ``Store.merchants_with`` finds them: up to ``FEW_NAMES`` reach the scan as a filter, more are joined."""
    in_range = in_date_range(transactions, time_col, date_from, date_to)
    if names is None:
        matching = in_range.where(contains_ignore_case(F.col("merchant_name"), name))
    else:
        few = [r.merchant_name for r in names.limit(FEW_NAMES + 1).collect()]
        if len(few) <= FEW_NAMES:
            matching = in_range.where(F.col("merchant_name").isin(few))
        else:
            matching = in_range.join(names, "merchant_name", "left_semi")
    return _page_of(matching, categories, page, page_size, order, direction)


def transaction_by_id(transactions: DataFrame, categories: DataFrame, external_id: str) -> DataFrame:
    """One row, or none when the id is unknown."""
    found = transactions.where(F.col("external_id") == external_id).limit(1)
    return project(found, categories)


def top_transactions(
    transactions: DataFrame,
    limit: int = 10,
    account_id: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    time_col: str = "created_at",
) -> DataFrame:
    """The largest transactions."""
    matching = select_transactions(transactions, account_id, status, date_from, date_to, time_col)
    return top_k(matching, [F.col("amount").desc(), F.col("source_id").asc()], limit)


def merchant_totals(transactions: DataFrame, require_mcc: bool = True) -> DataFrame:
    """Spend and count per merchant name and MCC. Rows without an MCC are left out by default."""
    named = transactions.where(F.col("merchant_name").isNotNull())
    if require_mcc:
        named = named.where(F.col("merchant_mcc").isNotNull())
    return named.groupBy("merchant_name", "merchant_mcc").agg(
        F.sum("amount").cast(TOTAL).alias("total_spend"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def top_merchants(
    transactions: DataFrame,
    limit: int = 10,
    account_id: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    time_col: str = "created_at",
    require_mcc: bool = True,
) -> DataFrame:
    """Merchants with the largest total; the limit is applied after grouping."""
    matching = select_transactions(transactions, account_id, status, date_from, date_to, time_col)
    keys = [F.col("total_spend").desc(), F.col("merchant_name").asc(), F.col("merchant_mcc").asc()]
    return top_k(merchant_totals(matching, require_mcc), keys, limit)


def payload_fields(transactions: DataFrame, **paths: str) -> DataFrame:
    """Fields of the stored source record, e.g. ``city="$.merchant_city"``."""
    return transactions.select(
        "source_id",
        "source_type",
        *[F.get_json_object("raw_payload", path).alias(name) for name, path in paths.items()],
    )


def stored_payload_fields(payloads: DataFrame, **paths: str) -> DataFrame:
    """The same from the stored source records, which were parsed when they were written. A field that is no text is given
    as its JSON."""
    return payloads.select(
        "source_id",
        "source_type",
        *[F.try_variant_get("payload", path, "string").alias(name) for name, path in paths.items()],
    )
