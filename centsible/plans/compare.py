"""Period-over-period comparison and spend anomalies.

Both periods come out of one scan and one shuffle of the rollup: each row adds to the sums of
the period(s) it lies in. ``per`` makes one report per value of the given columns, e.g. one
per account, in the same job; without it there is one report over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centsible.functions.numbers import direction, percent, three_significant_digits
from centsible.functions.periods import bucket_ordinal, previous_window
from centsible.plans.spending import select_rollup
from centsible.schemas import DAILY, MONEY, TOTAL
from centsible.session import scratch_path

# Fixed values.
Z_SCORE_THRESHOLD = 2.0
MIN_CATEGORIES = 3
SPIKE = "SPIKE"
DROP = "DROP"


@dataclass(frozen=True)
class ComparisonRequest:
    """The previous window defaults to the same number of days before the current one."""

    current_from: date
    current_to: date
    previous_from: date | None = None
    previous_to: date | None = None
    account_id: str | None = None
    period_type: str = DAILY
    category_codes: tuple[str, ...] | None = None

    @property
    def previous(self) -> tuple[date, date]:
        start, end = previous_window(self.current_from, self.current_to)
        return self.previous_from or start, self.previous_to or end

    def in_current(self) -> Column:
        return F.col("period_date").between(F.lit(self.current_from), F.lit(self.current_to))

    def in_previous(self) -> Column:
        start, end = self.previous
        return F.col("period_date").between(F.lit(start), F.lit(end))


class Comparison(NamedTuple):
    periods: DataFrame
    delta: DataFrame
    by_category: DataFrame
    time_series: DataFrame
    anomalies: DataFrame


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def _both_windows(rollup: DataFrame, categories: DataFrame, request: ComparisonRequest) -> DataFrame:
    rows = select_rollup(rollup, request.account_id, request.period_type)
    rows = rows.where(request.in_current() | request.in_previous())
    if request.category_codes is not None:
        wanted = categories.where(F.col("code").isin(*request.category_codes))
        rows = rows.join(wanted.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    return rows


def category_sums(
    rollup: DataFrame, categories: DataFrame, request: ComparisonRequest, per: Sequence[str] = ()
) -> DataFrame:
    """Spend and count of both periods per report and category."""
    now, before = request.in_current(), request.in_previous()
    return (
        _both_windows(rollup, categories, request)
        .groupBy(*per, "category_id")
        .agg(
            _total(F.when(now, F.col("total_spend"))).alias("current_spend"),
            _total(F.when(before, F.col("total_spend"))).alias("previous_spend"),
            F.coalesce(F.sum(F.when(now, F.col("transaction_count"))), F.lit(0)).alias("current_count"),
            F.coalesce(F.sum(F.when(before, F.col("transaction_count"))), F.lit(0)).alias("previous_count"),
            F.max(now).alias("is_current"),
        )
    )


def report_totals(sums: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Totals of both periods; a report without any row still has its zeros when ``per`` is empty."""
    return sums.groupBy(*per).agg(
        _total(F.col("current_spend")).alias("current_spend"),
        _total(F.col("previous_spend")).alias("previous_spend"),
        F.coalesce(F.sum("current_count"), F.lit(0)).alias("current_count"),
        F.coalesce(F.sum("previous_count"), F.lit(0)).alias("previous_count"),
    )


def period_summaries(totals: DataFrame, request: ComparisonRequest, per: Sequence[str] = ()) -> DataFrame:
    """Two rows per report: the current and the previous period."""
    start, end = request.previous
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("period"),
                F.lit(first).alias("period_from"),
                F.lit(last).alias("period_to"),
                F.col(f"{name}_spend").alias("total_spend"),
                F.col(f"{name}_count").alias("transaction_count"),
            )
            for name, first, last in (
                ("current", request.current_from, request.current_to),
                ("previous", start, end),
            )
        ]
    )
    return totals.select(*per, F.inline(rows))


def spend_delta(totals: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    change = F.col("current_spend") - F.col("previous_spend")
    return totals.select(
        *per,
        F.round(change, 2).cast("decimal(36,2)").alias("absolute_spend"),
        percent(change, F.col("previous_spend"), scale=6).alias("spend_percentage"),
        (F.col("current_count") - F.col("previous_count")).alias("count_absolute"),
        direction(change).alias("direction"),
    )


def category_breakdown(sums: DataFrame, categories: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Both spends, change and share per category of the current period, unsorted. Categories
    that only have previous rows are left out. The window spans one report, which has at most
    one row per category."""
    report = Window.partitionBy(*per)
    change = F.col("current_spend") - F.col("previous_spend")
    names = categories.select(
        F.col("id").alias("category_id"),
        F.col("code").alias("category_code"),
        F.col("label").alias("category_label"),
    )
    return (
        sums.where("is_current")
        .withColumn("current_total", F.sum("current_spend").over(report))
        # spend in a category that the dimension does not know stays, without a name
        .join(names, "category_id", "left")
        .select(
            *per,
            "category_code",
            "category_label",
            "current_spend",
            "previous_spend",
            percent(change, F.col("previous_spend")).alias("delta_pct"),
            percent(F.col("current_spend"), F.col("current_total")).alias("share_of_total_current"),
        )
    )


def by_spend(breakdown: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Largest current spend first, within each report."""
    return breakdown.orderBy(*per, F.col("current_spend").desc(), F.col("category_code").asc())


def detect_anomalies(breakdown: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """``find_anomalies`` in order, the farthest from the mean first."""
    found = find_anomalies(breakdown, per)
    return found.orderBy(*per, F.col("_size").desc(), F.col("category_code").asc()).drop("_size")


def find_anomalies(breakdown: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Categories whose change lies more than two standard deviations from the report's mean.

    The deviation is the population's, so at least six categories are needed for a hit; with
    fewer than three, or with equal changes, there is none. One outlier among five has a z-score of
    exactly 2, so the test is made in whole hundredths of a percent:
    (n d - sum)^2 > 4 (n sum of squares - sum^2). Only changes too large for 38 digits are tested as doubles.
    """
    report = Window.partitionBy(*per)
    delta = F.coalesce(F.col("delta_pct").cast("double"), F.lit(0.0))
    whole = F.coalesce((F.col("delta_pct") * 100).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    square = F.try_multiply(F.col("_whole"), F.col("_whole"))
    distance = F.try_subtract(F.try_multiply(F.col("_n"), F.col("_whole")), F.col("_sum"))
    spread = F.try_subtract(
        F.try_multiply(F.col("_n"), F.col("_squares")), F.try_multiply(F.col("_sum"), F.col("_sum"))
    )
    exact = F.try_multiply(distance, distance) > F.try_multiply(F.lit(4).cast("decimal(38,0)"), spread)
    rough = F.abs("_z") > Z_SCORE_THRESHOLD
    scored = (
        breakdown.withColumn("_delta", delta)
        .withColumn("_whole", whole)
        .withColumn("_sum", F.try_sum("_whole").over(report))
        .withColumn("_squares", F.try_sum(square).over(report))
        .withColumn("_n", F.count(F.lit(1)).over(report).cast("decimal(38,0)"))
        .withColumn("_mean", F.avg("_delta").over(report))
        .withColumn("_stddev", F.stddev_pop("_delta").over(report))
        .where((F.col("_n") >= MIN_CATEGORIES) & (F.col("_stddev") > 0) & F.col("delta_pct").isNotNull())
        .withColumn("_z", (F.col("_delta") - F.col("_mean")) / F.col("_stddev"))
        .where(F.coalesce(exact, rough))
    )
    above = F.col("_z") > 0
    return scored.select(
        *per,
        "category_code",
        F.when(above, SPIKE).otherwise(DROP).alias("reason"),
        three_significant_digits(F.col("_z")).alias("z_score"),
        F.format_string(
            "%s spend %.1f%% %s compared to previous period",
            F.col("category_label"),
            F.abs(F.col("_delta")),
            F.when(above, "above").otherwise("below"),
        ).alias("description"),
        F.abs("_z").alias("_size"),
    )


def compare_series(
    rollup: DataFrame, categories: DataFrame, request: ComparisonRequest, per: Sequence[str] = ()
) -> DataFrame:
    """Current and previous spend per bucket. The n-th bucket of the current window is paired
    with the n-th of the previous one; buckets without current rows are left out."""
    per_bucket = (
        _in_buckets(_both_windows(rollup, categories, request), request, *per)
        .groupBy(*per, "bucket")
        .agg(F.max("day").alias("period_date"), *_both_spends())
    )
    return series_of(per_bucket, per).orderBy(*per, "period_date")


def _in_buckets(rows: DataFrame, request: ComparisonRequest, *columns: str) -> DataFrame:
    """Each row with its bucket in the window, or windows, that it lies in: bucket, day, now, before and their counts."""
    previous_from, _ = request.previous
    day, spend, count, none = F.col("period_date"), F.col("total_spend"), F.col("transaction_count"), F.lit(None)
    sides = F.array(
        F.when(
            request.in_current(),
            F.struct(
                bucket_ordinal(day, request.current_from, request.period_type).alias("bucket"),
                day.alias("day"),
                spend.alias("now"),
                none.cast(MONEY).alias("before"),
                count.alias("now_count"),
                none.cast("bigint").alias("before_count"),
            ),
        ),
        F.when(
            request.in_previous(),
            F.struct(
                bucket_ordinal(day, previous_from, request.period_type).alias("bucket"),
                none.cast("date").alias("day"),
                none.cast(MONEY).alias("now"),
                spend.alias("before"),
                none.cast("bigint").alias("now_count"),
                count.alias("before_count"),
            ),
        ),
    )
    return rows.select(*columns, F.inline(F.array_compact(sides)))


def _both_spends() -> list[Column]:
    return [_total(F.col("now")).alias("current_spend"), _total(F.col("before")).alias("previous_spend")]


def series_of(per_bucket: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The buckets of the current window; the day of a bucket is that of its current rows."""
    return per_bucket.where(F.col("period_date").isNotNull()).select(*per, "period_date", "current_spend", "previous_spend")


def compare(
    rollup: DataFrame,
    categories: DataFrame,
    request: ComparisonRequest,
    per: Sequence[str] = (),
) -> Comparison:
    sums = category_sums(rollup, categories, request, per)
    totals = report_totals(sums, per)
    breakdown = category_breakdown(sums, categories, per)
    return Comparison(
        periods=period_summaries(totals, request, per),
        delta=spend_delta(totals, per),
        by_category=by_spend(breakdown, per),
        time_series=compare_series(rollup, categories, request, per),
        anomalies=detect_anomalies(breakdown, per),
    )


def compare_report(rollup: DataFrame, categories: DataFrame, request: ComparisonRequest) -> DataFrame:
    """One row with the whole report: two period structs, the delta struct and three lists, each bounded by the number
    of categories or buckets.

    The rollup is read once: one grouping by category and, beside it, by bucket gives a table of as many rows, from
    which totals, breakdown, series and anomalies are made.
    """
    rows = _in_buckets(_both_windows(rollup, categories, request), request, "category_id")
    cells = rows.groupingSets([["category_id"], ["bucket"]], "category_id", "bucket").agg(
        F.grouping("bucket").alias("by_category"),
        F.max("day").alias("period_date"),
        *_both_spends(),
        F.coalesce(F.sum("now_count"), F.lit(0)).alias("current_count"),
        F.coalesce(F.sum("before_count"), F.lit(0)).alias("previous_count"),
        F.max(F.col("now").isNotNull()).alias("is_current"),
    )
    path = scratch_path(rollup.sparkSession, "comparison")
    cells.coalesce(1).write.parquet(path)
    cells = rollup.sparkSession.read.schema(cells.schema).parquet(path)
    sums = cells.where("by_category = 1")
    totals = report_totals(sums)
    breakdown = category_breakdown(sums, categories)
    spend = F.struct(-F.col("current_spend"), "category_code")
    return nested(
        period_summaries(totals, request),
        spend_delta(totals),
        (breakdown, spend),
        (series_of(cells.where("by_category = 0")), F.struct("period_date")),
        (find_anomalies(breakdown), F.struct(-F.col("_size"), "category_code")),
    )


def nested(
    periods: DataFrame,
    delta: DataFrame,
    by_category: tuple[DataFrame, Column],
    time_series: tuple[DataFrame, Column],
    anomalies: tuple[DataFrame, Column],
) -> DataFrame:
    """The parts of a report, the lists with what they are sorted by, as one row."""

    def as_list(part: tuple[DataFrame, Column], name: str) -> Column:
        df, order = part
        fields = [c for c in df.columns if not c.startswith("_")]
        rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*fields).alias("row"))))
        return df.agg(F.transform(rows, lambda row: row["row"]).alias(name)).scalar()

    def only(df: DataFrame, condition: str | None = None) -> Column:
        rows = df.where(condition) if condition else df
        return rows.select(F.struct(*rows.columns)).scalar()

    return delta.sparkSession.range(1).select(
        only(periods, "period = 'current'").alias("current"),
        only(periods, "period = 'previous'").alias("previous"),
        only(delta).alias("delta"),
        as_list(by_category, "by_category").alias("by_category"),
        as_list(time_series, "time_series").alias("time_series"),
        as_list(anomalies, "anomalies").alias("anomalies"),
    )
