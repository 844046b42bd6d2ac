from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from centsible.operators import rollup as ro
from centsible.operators.categorise import categorise
from centsible.sources.tables import Store, to_transactions


@pytest.fixture
def facts(make, categories):
    def build(*records):
        return to_transactions(categorise(make(*records), categories))

    return build


MIXED = [
    {"account_id": f"A{i % 5}", "amount": str(1 + i), "merchant_name": ["Uber", "Netflix", "Zzz"][i % 3],
     "status": ["SETTLED", "REVERSED", "PENDING", "SETTLED"][i % 4],
     "transacted_at": datetime(2023, 1 + i % 12, 1 + i % 28, i % 24)}
    for i in range(240)
]


def measures(df):
    return df.agg(F.sum("total_spend"), F.sum("transaction_count"), F.sum("total_reversed")).first()


def as_set(df):
    return {tuple(r) for r in df.drop("updated_at").collect()}


def test_status_decides_the_measure(facts):
    rows = facts({"amount": "5"}, {"amount": "7", "status": "REVERSED"}, {"amount": "9", "status": "PENDING"})
    row = ro.rollup(rows, ["DAILY"]).first()
    assert (row.total_spend, row.transaction_count, row.total_reversed) == (Decimal(5), 1, Decimal(7))


def test_first_reversal_counts_once(facts):
    row = ro.rollup(facts({"amount": "40", "status": "REVERSED"}), ["MONTHLY"]).first()
    assert (row.total_spend, row.transaction_count, row.total_reversed) == (Decimal(0), 0, Decimal(40))


def test_pending_only_leaves_no_row(facts):
    assert ro.rollup(facts({"status": "PENDING"})).count() == 0


def test_week_starts_on_monday(facts):
    rows = facts(
        {"transacted_at": datetime(2024, 3, 10, 23, 59, 59)}, {"transacted_at": datetime(2024, 3, 11, 0, 0)}
    )
    weeks = {r.period_date for r in ro.rollup(rows, ["WEEKLY"]).collect()}
    assert weeks == {date(2024, 3, 4), date(2024, 3, 11)}
    assert {r.period_date for r in ro.rollup(rows, ["MONTHLY"]).collect()} == {date(2024, 3, 1)}


def test_periods_agree_on_every_account_and_category(facts):
    full = ro.rollup(facts(*MIXED))
    sums = full.groupBy("account_id", "category_id", "period_type").agg(
        F.sum("total_spend").alias("s"), F.sum("transaction_count").alias("n"), F.sum("total_reversed").alias("r")
    )
    distinct = sums.groupBy("account_id", "category_id").agg(F.countDistinct("s", "n", "r").alias("variants"))
    assert distinct.where("variants <> 1").count() == 0


def test_incremental_equals_recomputed(spark, facts, tmp_path):
    rows = facts(*MIXED)
    store = Store(spark, str(tmp_path))
    thirds = [rows.where(F.pmod(F.xxhash64("source_id"), F.lit(3)) == i) for i in range(3)]
    for batch_id, part in enumerate(thirds):
        store.write_rollup_part(ro.daily_rollup(part), batch_id)
    expected = as_set(ro.rollup(rows))
    assert as_set(store.rollup()) == expected
    store.write_rollup_part(ro.daily_rollup(thirds[1]), 1)  # replay
    assert as_set(store.rollup()) == expected
    store.compact_rollup(1)
    assert as_set(store.rollup()) == expected
    store.compact_rollup(2)
    assert as_set(store.rollup()) == expected
    assert as_set(store.rollup(("WEEKLY",))) == {r for r in expected if "WEEKLY" in r}


def test_transactions_survive_compaction(spark, facts, tmp_path):
    rows = facts(*MIXED)
    store = Store(spark, str(tmp_path), day_bytes=1)
    assert store.transactions().count() == 0
    for batch_id in range(3):
        store.write_transactions(rows.where(F.pmod(F.xxhash64("source_id"), F.lit(3)) == batch_id), batch_id)
    before = {r.source_id: r.amount for r in store.transactions().collect()}
    assert len(before) == len(MIXED)
    store.compact_transactions(0)
    store.compact_transactions(1)
    assert {r.source_id: r.amount for r in store.transactions().collect()} == before
    assert store.transactions().count() == len(MIXED)
    day = store.transactions().where("transacted_date = '2023-01-01'")
    assert day.count() == rows.where("transacted_date = '2023-01-01'").count()
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert any("transacted_date" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
