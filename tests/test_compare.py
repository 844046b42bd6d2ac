from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from centsible.functions.numbers import direction, percent, ten_thousandths, three_significant_digits
from centsible.functions.periods import previous_window
from centsible.plans import compare as cp
from centsible.schemas import ROLLUP_SCHEMA


@pytest.fixture
def rollup(spark):
    """rows of (account, category, day, spend[, count])"""

    def build(*rows, period_type="DAILY"):
        data = [
            (r[0], r[1], date.fromisoformat(r[2]), Decimal(str(r[3])), r[4] if len(r) > 4 else 1, Decimal(0), None, period_type)
            for r in rows
        ]
        return spark.createDataFrame(data, ROLLUP_SCHEMA)

    return build


MARCH = cp.ComparisonRequest(date(2026, 3, 1), date(2026, 3, 31))


@pytest.mark.parametrize(
    "part, whole, expected",
    [
        ("200", "1000", "20.00"),
        ("1", "3", "33.33"),
        ("2", "3", "66.67"),
        ("-1", "3", "-33.33"),
        ("0.05", "1000", "0.01"),  # exactly half
        ("-0.05", "1000", "-0.01"),
        ("1", "30000", "0.00"),
        ("5", "0", "0.00"),
        ("900000000000", "0.01", "9000000000000000.00"),
        ("123456789012.3456", "0.0001", "123456789012345600.00"),
        ("-123456789012.3456", "0.0001", "-123456789012345600.00"),
    ],
)
def test_percent_rounds_half_up_once(spark, part, whole, expected):
    df = spark.sql(f"SELECT CAST({part} AS DECIMAL(38,4)) p, CAST({whole} AS DECIMAL(38,4)) w")
    value = df.select(percent(F.col("p"), F.col("w")).alias("v")).first().v
    assert value == Decimal(expected)


def test_ratio_near_a_half_is_not_rounded_twice(spark):
    # 0.00004999999999975 would become 0.0001 if it were first rounded to 9 decimals
    df = spark.sql("SELECT CAST(99999.9999 AS DECIMAL(38,4)) p, CAST(2000000000 AS DECIMAL(38,4)) w")
    assert df.select(ten_thousandths(F.col("p"), F.col("w")).alias("v")).first().v == 0


@pytest.mark.parametrize("z, expected", [(2.236, "2.24"), (-2.6458, "-2.65"), (2.005, "2.01"), (12.345, "12.3"), (123.5, "124")])
def test_three_significant_digits(spark, z, expected):
    df = spark.createDataFrame([(z,)], "z double")
    assert df.select(three_significant_digits(F.col("z")).alias("v")).first().v == Decimal(expected)


def test_direction(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,)], "x int")
    assert [r.d for r in df.select(direction(F.col("x")).alias("d")).collect()] == ["INCREASE", "DECREASE", "FLAT"]


def test_previous_window():
    assert previous_window(date(2026, 3, 1), date(2026, 3, 31)) == (date(2026, 1, 29), date(2026, 2, 28))
    assert MARCH.previous == (date(2026, 1, 29), date(2026, 2, 28))
    fixed = cp.ComparisonRequest(date(2026, 3, 1), date(2026, 3, 31), date(2026, 2, 1))
    assert fixed.previous == (date(2026, 2, 1), date(2026, 2, 28))


def test_totals_delta_and_breakdown(rollup, categories):
    rows = rollup(
        ("A", 2, "2026-03-05", "1200", 3),
        ("A", 2, "2026-02-10", "1000", 2),
        ("B", 3, "2026-03-06", "300", 1),
        ("A", 5, "2026-02-11", "50", 1),  # only in the previous period
        ("A", 6, "2025-12-01", "999", 9),  # in neither
    )
    result = cp.compare(rows, categories, MARCH)
    periods = {r.period: (r.total_spend, r.transaction_count) for r in result.periods.collect()}
    assert periods == {"current": (Decimal(1500), 4), "previous": (Decimal(1050), 3)}
    delta = result.delta.first()
    assert (delta.absolute_spend, delta.spend_percentage) == (Decimal("450.00"), Decimal("42.860000"))
    assert (delta.count_absolute, delta.direction) == (1, "INCREASE")
    table = [
        (r.category_code, r.current_spend, r.previous_spend, r.delta_pct, r.share_of_total_current)
        for r in result.by_category.collect()
    ]
    assert table == [
        ("groceries", Decimal(1200), Decimal(1000), Decimal("20.00"), Decimal("80.00")),
        ("restaurants", Decimal(300), Decimal(0), Decimal("0.00"), Decimal("20.00")),
    ]
    assert result.anomalies.count() == 0


def test_previous_total_zero_and_empty(rollup, categories):
    delta = cp.compare(rollup(("A", 2, "2026-03-05", "10")), categories, MARCH).delta.first()
    assert (delta.spend_percentage, delta.direction) == (Decimal(0), "INCREASE")
    empty = cp.compare(rollup(), categories, MARCH)
    assert empty.delta.first().direction == "FLAT"
    assert [r.transaction_count for r in empty.periods.collect()] == [0, 0]


def test_account_and_category_filters(rollup, categories):
    rows = rollup(("A", 2, "2026-03-05", "10"), ("B", 2, "2026-03-05", "20"), ("A", 3, "2026-03-05", "40"))
    request = cp.ComparisonRequest(date(2026, 3, 1), date(2026, 3, 31), account_id="A", category_codes=("groceries",))
    assert cp.compare(rows, categories, request).periods.first().total_spend == Decimal(10)


def test_series_pairs_buckets_by_place(rollup, categories):
    rows = rollup(
        ("A", 2, "2026-03-01", "10"),
        ("A", 3, "2026-03-01", "5"),
        ("A", 2, "2026-03-03", "7"),
        ("A", 2, "2026-01-29", "4"),
        ("A", 2, "2026-01-30", "100"),  # no current bucket to pair with
    )
    series = [tuple(r) for r in cp.compare_series(rows, categories, MARCH).collect()]
    assert series == [
        (date(2026, 3, 1), Decimal(15), Decimal(4)),
        (date(2026, 3, 3), Decimal(7), Decimal(0)),
    ]


def test_series_by_month(rollup, categories):
    rows = rollup(("A", 2, "2026-02-01", "10"), ("A", 2, "2025-02-01", "3"), period_type="MONTHLY")
    request = cp.ComparisonRequest(
        date(2026, 1, 1), date(2026, 3, 31), date(2025, 1, 1), date(2025, 3, 31), period_type="MONTHLY"
    )
    series = [tuple(r) for r in cp.compare_series(rows, categories, request).collect()]
    assert series == [(date(2026, 2, 1), Decimal(10), Decimal(3))]


def changes(rollup, *pairs):
    rows = []
    for category, (before, now) in enumerate(pairs, start=2):
        rows += [("A", category, "2026-02-10", before), ("A", category, "2026-03-10", now)]
    return rollup(*rows)


def test_spike_among_six_categories(rollup, categories):
    rows = changes(rollup, (100, 900), *[(100, 100 + i) for i in range(5)])
    found = cp.compare(rows, categories, MARCH).anomalies.collect()
    assert [(r.category_code, r.reason) for r in found] == [("groceries", "SPIKE")]
    assert found[0].z_score == Decimal("2.24")
    assert found[0].description == "Groceries spend 800.0% above compared to previous period"


def test_drop_and_order(rollup, categories):
    rows = changes(rollup, (1000, 10), *[(1000, 1000)] * 9)
    found = cp.compare(rows, categories, MARCH).anomalies.collect()
    assert [(r.category_code, r.reason) for r in found] == [("groceries", "DROP")]
    assert found[0].description == "Groceries spend 99.0% below compared to previous period"


@pytest.mark.parametrize(
    "pairs",
    [
        [(100, 900), (100, 100)],
        [(100, 120)] * 8,
        [(100, 900), (100, 100), (100, 100)],
        [(100, 133.37), (100, 100), (100, 100), (100, 100), (100, 100)],  # z is exactly 2
        [(100, 177.77), (0, 100), (0, 10), (0, 1), (0, 3)],
    ],
)
def test_no_anomalies(rollup, categories, pairs):
    assert cp.compare(changes(rollup, *pairs), categories, MARCH).anomalies.count() == 0


def test_text_rounds_half_up(spark):
    breakdown = spark.createDataFrame(
        [(f"c{i}", "Label", Decimal("0.00")) for i in range(9)] + [("x", "Label", Decimal("12.25"))],
        "category_code string, category_label string, delta_pct decimal(21,2)",
    )
    assert "12.3%" in cp.detect_anomalies(breakdown).first().description


def test_many_reports_at_once(rollup, categories):
    rows = rollup(
        ("A", 2, "2026-03-05", "10"), ("A", 2, "2026-02-05", "20"), ("B", 2, "2026-03-05", "30"), ("B", 3, "2026-03-05", "10")
    )
    per = ["account_id"]
    every = cp.compare(rows, categories, MARCH, per)
    assert {(r.account_id, r.direction) for r in every.delta.collect()} == {("A", "DECREASE"), ("B", "INCREASE")}
    for account in ("A", "B"):
        request = cp.ComparisonRequest(MARCH.current_from, MARCH.current_to, account_id=account)
        alone = cp.compare(rows, categories, request).by_category.collect()
        mine = every.by_category.where(F.col("account_id") == account).drop("account_id").collect()
        assert mine == alone


def test_whole_report(rollup, categories):
    rows = changes(rollup, (100, 900), *[(100, 100 + i) for i in range(5)])
    report = cp.compare_report(rows, categories, MARCH).first()
    assert report.current.total_spend == Decimal(1410) and report.delta.direction == "INCREASE"
    assert [r.category_code for r in report.by_category][0] == "groceries" and len(report.by_category) == 6
    assert len(report.time_series) == 1 and report.anomalies[0].reason == "SPIKE"
    parts = cp.compare(rows, categories, MARCH)
    assert report.by_category == parts.by_category.collect() and report.time_series == parts.time_series.collect()
    assert report.anomalies == parts.anomalies.collect() and report.delta == parts.delta.first()
    assert report.previous.asDict() == {k: v for k, v in parts.periods.where("period = 'previous'").first().asDict().items()}


def test_whole_report_of_nothing(rollup, categories):
    report = cp.compare_report(rollup(("A", 2, "2020-01-01", "1")), categories, MARCH).first()
    assert report.current.total_spend == 0 and report.delta.direction == "FLAT"
    assert report.by_category == report.time_series == report.anomalies == []
