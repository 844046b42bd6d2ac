import random

from pyspark.sql import functions as F

from centsible.operators import dedup
from centsible.operators.validate import ingest_rules
from centsible.schemas import CARD_NETWORK, CARD_SCHEMA, PAYMENT_PROCESSOR
from tests.conftest import AS_OF

RULES = ingest_rules(AS_OF)


def brute_outcomes(records):
    """What one record after the other would give."""
    seen, outcomes = set(), []
    for record in sorted(records, key=lambda r: r["arrival_seq"]):
        if float(record["amount"]) <= 0:
            outcomes.append((record["arrival_seq"], "FAILED"))
        elif record["source_id"] in seen:
            outcomes.append((record["arrival_seq"], "DUPLICATE"))
        else:
            seen.add(record["source_id"])
            outcomes.append((record["arrival_seq"], "ACCEPTED"))
    return sorted(outcomes)


def skewed(seed=7, size=900):
    """A third of the rows share one id; some rows are invalid, also first copies."""
    rng = random.Random(seed)
    sequence = list(range(size))
    rng.shuffle(sequence)
    return [
        {
            "arrival_seq": sequence[i],
            "source_id": "hot" if i % 3 == 0 else f"id-{rng.randrange(200)}",
            "source_type": rng.choice(["BANK_FEED", "PAYMENT_PROCESSOR"]),
            "amount": "0" if rng.random() < 0.1 else "5",
        }
        for i in range(size)
    ]


def test_first_wins_keeps_the_first_row(make):
    df = make(
        {"source_id": "a", "arrival_seq": 2, "amount": "2"},
        {"source_id": "a", "arrival_seq": 1, "amount": "1"},
        {"source_id": "b", "arrival_seq": 3, "amount": "3"},
    )
    kept = {(r.source_id, int(r.amount)) for r in dedup.first_wins(df, "source_id").collect()}
    assert kept == {("a", 1), ("b", 3)}


def test_first_wins_limits_groups_before_the_shuffle(make):
    plan = dedup.first_wins(make({}), "source_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_outcomes_match_one_by_one_processing(make):
    records = skewed()
    out = dedup.classify_outcomes(make(*records), RULES)
    assert sorted((r.arrival_seq, r.outcome) for r in out.collect()) == brute_outcomes(records)


def test_outcomes_of_equal_rows(make):
    """Fully equal copies: exactly one is accepted."""
    same = {"source_id": "x", "arrival_seq": 1}
    out = dedup.classify_outcomes(make(same, same, same), RULES)
    assert sorted(r.outcome for r in out.collect()) == ["ACCEPTED", "DUPLICATE", "DUPLICATE"]


def test_outcomes_use_no_window_over_a_key(make):
    """A hot key is reduced before the shuffle and marked by a join; no window holds all its rows."""
    plan = dedup.classify_outcomes(make({}), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" in plan


def test_rows_at_the_same_place_that_differ(make):
    """One of them is accepted, the same one in every run."""
    rows = [{"source_id": "x", "arrival_seq": 1, "merchant_name": name} for name in ("b", "a", "a")]
    out = dedup.classify_outcomes(make(*rows), RULES).collect()
    assert sorted((r.merchant_name, r.outcome) for r in out) == [("a", "ACCEPTED"), ("a", "DUPLICATE"), ("b", "DUPLICATE")]


def test_counts_match_outcomes(make):
    records = skewed(seed=8)
    expected = {}
    kinds = {r["arrival_seq"]: r["source_type"] for r in records}
    for sequence, outcome in brute_outcomes(records):
        key = (kinds[sequence], outcome)
        expected[key] = expected.get(key, 0) + 1
    counted = dedup.count_outcomes(make(*records), RULES)
    assert {(r.source_type, r.outcome): r.records for r in counted.collect() if r.records} == expected
    assert sum(expected.values()) == len(records)


def test_drop_stored(make, spark):
    batch = make({"source_id": "a"}, {"source_id": "b"}, {"source_id": "c"})
    stored = spark.createDataFrame([("b",), ("z",)], "source_id string")
    assert {r.source_id for r in dedup.drop_stored(batch, stored).collect()} == {"a", "c"}


def test_source_repeats_use_the_event_id_for_payments(spark):
    raw = spark.createDataFrame(
        [("e1", "p1", 1), ("e1", "p1", 2), ("e2", "p1", 3), (None, "p9", 4), (None, "p8", 5)],
        "event_id string, payment_id string, arrival_seq long",
    )
    kept = dedup.drop_source_repeats(raw, PAYMENT_PROCESSOR).collect()
    assert sorted(r.arrival_seq for r in kept) == [1, 3, 4, 5]


def test_source_repeats_card(spark):
    raw = spark.createDataFrame([], CARD_SCHEMA).withColumn("arrival_seq", F.lit(1))
    assert dedup.drop_source_repeats(raw, CARD_NETWORK).count() == 0


def test_no_row_is_rebuilt_from_a_count(make):
    """One record for all rows: copies stay rows, and nothing is expanded in one task."""
    same = {"source_id": "x", "arrival_seq": 1}
    out = dedup.classify_outcomes(make(*[same] * 200), RULES)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.outcome for r in out.collect()) == ["ACCEPTED"] + ["DUPLICATE"] * 199


def test_outcomes_move_no_wide_row(make, spark):
    """Only firsts and their numbers are shuffled, also where no table counts as small."""
    records = skewed(seed=9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = dedup.classify_outcomes(make(*records), RULES)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.arrival_seq, r.outcome) for r in out.collect()) == brute_outcomes(records)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
