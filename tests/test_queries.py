from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from centsible.operators import paging
from centsible.operators.categorise import categorise
from centsible.operators.rollup import rollup
from centsible.plans import categories as pc
from centsible.plans import spending
from centsible.plans import transactions as pt
from centsible.sources.tables import to_transactions

START = datetime(2024, 3, 1, 8)


@pytest.fixture
def facts(make, categories):
    rows = [
        {
            "source_id": f"t{i:03d}",
            "account_id": "A" if i % 2 else "B",
            "amount": str(1 + (i * 37) % 50),
            "merchant_name": ["Uber Trip", "Netflix", "100% Rain_coats", "Zzz"][i % 4],
            "merchant_mcc": "4121" if i % 4 == 0 else None,
            "status": "SETTLED" if i % 5 else "REVERSED",
            "transacted_at": START + timedelta(hours=7 * i),
            "ingested_at": START + timedelta(hours=7 * i),
        }
        for i in range(90)
    ]
    return to_transactions(categorise(make(*rows), categories)).cache()


def test_pages_cover_everything_once(facts, categories):
    seen = []
    for page in range(6):
        seen += [r.source_id for r in pt.list_transactions(facts, categories, page=page, page_size=17).data.collect()]
    assert len(seen) == 90 and len(set(seen)) == 90
    by_time = [r.source_id for r in facts.orderBy("created_at", "source_id").collect()]
    assert seen == by_time


def test_meta(facts, categories):
    meta = pt.list_transactions(facts, categories, page=5, page_size=17).meta.first()
    assert (meta.total_count, meta.total_pages, meta.has_more) == (90, 6, False)
    beyond = pt.list_transactions(facts, categories, page=50, page_size=17)
    assert beyond.data.count() == 0 and beyond.meta.first().total_count == 90
    none = pt.list_transactions(facts, categories, account_id="nobody").meta.first()
    assert (none.total_count, none.total_pages, none.has_more) == (0, 0, False)


def test_filters(facts, categories):
    page = pt.list_transactions(
        facts, categories, "A", "SETTLED", date(2024, 3, 3), date(2024, 3, 9), page_size=100, order="amount", direction="ASC"
    )
    rows = page.data.collect()
    assert rows and all(r.account_id == "A" and r.status == "SETTLED" for r in rows)
    assert all(date(2024, 3, 3) <= r.created_at.date() <= date(2024, 3, 9) for r in rows)
    assert any(r.created_at.date() == date(2024, 3, 9) for r in rows)
    assert [r.amount for r in rows] == sorted(r.amount for r in rows)
    assert {r.category_code for r in rows} <= {"transport", "entertainment", "telecoms", "uncategorised"}


@pytest.mark.parametrize("order, direction", [("raw_payload", "asc"), ("amount", "sideways")])
def test_sort_is_allow_listed(facts, categories, order, direction):
    with pytest.raises(ValueError):
        pt.list_transactions(facts, categories, order=order, direction=direction)


KEYS = [paging.SortKey("amount", descending=True), paging.SortKey("source_id")]


def test_pages_sort_only_their_keys(facts, monkeypatch):
    """Shallow pages are a top-k; the others sort and write the two keys, never whole rows."""
    for page in (0, 2):
        plan = paging.take_page(facts, KEYS, page, 10)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "LeftSemi" not in plan
    monkeypatch.setattr(paging, "SHALLOW", 0)
    plan = paging.take_page(facts, KEYS, 2, 10)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if line.endswith("parquet")]  # the written keys
    assert "LeftSemi" in plan and scans and all("raw_payload" not in line for line in scans)


@pytest.mark.parametrize("shallow", [0, 100, 5000])
@pytest.mark.parametrize("page, size", [(0, 7), (3, 20), (8, 10), (9, 10), (40, 10)])
def test_page_equals_slice_of_all(facts, page, size, shallow, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", shallow)
    everything = [r.source_id for r in paging.sorted_by(facts, KEYS).collect()]
    found = [r.source_id for r in paging.take_page(facts, KEYS, page, size).collect()]
    assert found == everything[page * size : (page + 1) * size]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_after_a_row_cover_everything_once(facts, categories, direction):
    seen, after = [], None
    while True:
        rows = pt.list_transactions_after(facts, categories, after, 40, "amount", direction).collect()
        if not rows:
            break
        seen += [r.source_id for r in rows]
        after = (rows[-1].amount, rows[-1].source_id)
    keys = [paging.SortKey("amount", direction == "desc"), paging.SortKey("source_id")]
    assert seen == [r.source_id for r in paging.sorted_by(facts, keys).collect()]


def test_page_after_checks_its_arguments(facts):
    with pytest.raises(ValueError):
        paging.take_after(facts, KEYS, ("a",), 10)
    with pytest.raises(ValueError):
        paging.take_after(facts, KEYS, None, 0)


@pytest.mark.parametrize(
    "term, count", [("uber", 23), ("TRIP", 23), ("net", 23), ("%", 22), ("_", 22), ("n_t", 0), ("", 90)]
)
def test_merchant_search_is_literal_and_ignores_case(facts, categories, term, count):
    assert pt.merchant_search(facts, categories, term).meta.first().total_count == count


def test_by_id(facts, categories):
    known = facts.where("source_id = 't007'").first().external_id
    found = pt.transaction_by_id(facts, categories, known).collect()
    assert [r.source_id for r in found] == ["t007"]
    assert len(known) == 36 and pt.transaction_by_id(facts, categories, "x").count() == 0


def test_top_merchants_groups_before_the_limit(facts):
    expected = {}
    for r in facts.collect():
        if r.merchant_mcc:
            expected[r.merchant_name] = expected.get(r.merchant_name, 0) + r.amount
    rows = pt.top_merchants(facts, limit=1).collect()
    assert [(r.merchant_name, r.total_spend) for r in rows] == list(expected.items())
    assert pt.top_merchants(facts, limit=10, require_mcc=False).count() == 4


def test_top_transactions(facts):
    amounts = [r.amount for r in pt.top_transactions(facts, limit=5).collect()]
    assert amounts == sorted((r.amount for r in facts.collect()), reverse=True)[:5]


def test_time_filter_prunes_days(facts, spark, tmp_path):
    facts.write.partitionBy("transacted_date").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    rows = pt.select_transactions(
        stored, date_from=date(2024, 3, 5), date_to=date(2024, 3, 6), time_col="transacted_at"
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "transacted_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert rows.count() == facts.where("transacted_date BETWEEN '2024-03-05' AND '2024-03-06'").count()


def test_summary_and_series(facts, categories):
    full = rollup(facts)
    by_month = spending.category_summary(full, categories, period_type="MONTHLY").collect()
    by_day = spending.by_category(full, categories).collect()
    assert by_month == by_day
    assert [r.total_spend for r in by_day] == sorted((r.total_spend for r in by_day), reverse=True)
    settled = sum(r.amount for r in facts.collect() if r.status == "SETTLED")
    assert sum(r.total_spend for r in by_day) == settled
    series = spending.time_series(full, period_type="WEEKLY").collect()
    assert [r.period_date for r in series] == sorted(r.period_date for r in series)
    assert sum(r.total_spend for r in series) == settled
    one = spending.time_series(full, account_id="A", date_from=date(2024, 3, 2), date_to=date(2024, 3, 2)).collect()
    assert all(r.period_date == date(2024, 3, 2) for r in one)


def test_payload_fields(make):
    rows = make({"raw_payload": '{"city":"Paarl","n":{"k":3}}'}, {"raw_payload": "{}"})
    values = pt.payload_fields(rows, city="$.city", k="$.n.k").orderBy("source_id").collect()
    assert [(r.city, r.k) for r in values] == [("Paarl", "3"), (None, None)]


def test_category_queries(categories):
    first = pc.list_categories(categories, page_size=5)
    assert [r.path for r in first.data.collect()][:2] == ["entertainment", "entertainment.streaming"]
    assert first.meta.first().total_pages == 4
    found = pc.categories_by_mcc(categories, "5411, 5812,541").data.collect()
    assert {r.code for r in found} == {"groceries", "restaurants"}
    assert pc.categories_by_mcc(categories, " ,").meta.first().total_count == 0
    assert pc.root_categories(categories).count() == 8
    assert pc.categories_with_keywords(categories).count() == 18
    row = pc.category_by_code(categories, "fuel").first()
    assert pc.category_by_id(categories, row.external_id).first().mcc_codes == "5541,5542,5172"


def test_amounts_stay_decimal(facts, categories):
    total = spending.by_category(rollup(facts), categories).schema["total_spend"].dataType.simpleString()
    assert total == "decimal(38,4)"
    assert isinstance(facts.first().amount, Decimal)
