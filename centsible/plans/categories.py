"""Queries over the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.operators.paging import DEFAULT_PAGE_SIZE, Page, page_meta, sort_keys, sorted_by, take_page

# Public sort names.
CATEGORY_ORDER = {"path": "path", "label": "label", "code": "code"}


def project_categories(categories: DataFrame) -> DataFrame:
    return categories.select(
        "external_id", "code", "label", "path", F.array_join("mcc_codes", ",").alias("mcc_codes")
    )


def _page_of(matching: DataFrame, page: int, page_size: int, order: str, direction: str) -> Page:
    keys = sort_keys(CATEGORY_ORDER, order, direction, "code")
    rows = take_page(matching, keys, page, page_size)
    return Page(sorted_by(project_categories(rows), keys), page_meta(matching, page, page_size))


def list_categories(
    categories: DataFrame,
    page: int = 0,
    page_size: int = DEFAULT_PAGE_SIZE,
    order: str = "path",
    direction: str = "asc",
) -> Page:
    """Ascending path order puts parents before their children."""
    return _page_of(categories, page, page_size, order, direction)


def category_by_id(categories: DataFrame, external_id: str) -> DataFrame:
    return project_categories(categories.where(F.col("external_id") == external_id).limit(1))


def category_by_code(categories: DataFrame, code: str) -> DataFrame:
    return categories.where(F.col("code") == code)


def categories_by_mcc(
    categories: DataFrame,
    mcc_codes: str,
    page: int = 0,
    page_size: int = DEFAULT_PAGE_SIZE,
    order: str = "label",
    direction: str = "asc",
) -> Page:
    """Categories that list any of the comma-separated codes."""
    wanted = [code.strip() for code in mcc_codes.split(",") if code.strip()]
    matching = categories.where(
        F.arrays_overlap("mcc_codes", F.array(*[F.lit(code) for code in wanted]).cast("array<string>"))
    )
    return _page_of(matching, page, page_size, order, direction)


def root_categories(categories: DataFrame) -> DataFrame:
    return categories.where(F.col("parent_id").isNull())


def categories_with_keywords(categories: DataFrame) -> DataFrame:
    return categories.where(F.col("keywords").isNotNull())
