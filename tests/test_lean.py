"""What is moved and written: rules are compiled, stored rows stay where they are, copies are told by their numbers."""

from datetime import date
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

import __spark_entry__ as entry
from centsible.operators import classify, dedup, validate
from centsible.schemas import TRANSACTION_SCHEMA
from centsible.sources.manifest import names_in, renamed
from centsible.sources.tables import BY_DAY, Store
from centsible.streaming import accepted, ingest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_rule_stands_in_a_lambda(make):
    rows = make({"amount": "-1.00", "currency": "QQQ"}, {"account_id": " \t"}, {})
    judged = validate.with_reject_reasons(rows, validate.ingest_rules())
    assert "lambda" not in plan(judged)
    assert [(r.reject_reason, r.reject_reasons) for r in judged.orderBy("arrival_seq").collect()] == [
        ("amount_not_positive", ["amount_not_positive", "currency_missing"]),
        ("account_id_blank", ["account_id_blank"]),
        (None, []),
    ]
    assert validate.rejected_rows(rows, validate.ingest_rules()).count() == 2


@pytest.mark.parametrize("text, blank", [(None, True), ("", True), (" \t ", True), (" a ", False), ("a", False), (" ", False)])
def test_blank_texts(make, text, blank):
    rules = [("blank", validate.is_blank("merchant_name"))]
    assert validate.rejected_rows(make({"merchant_name": text}), rules).count() == blank
    assert "LEADING" in rules[0][1]


def transactions(make, **fields):
    rows = make({"source_id": "a", **fields})
    given = {"transacted_date": F.lit(date(2024, 3, 15)), "category_id": F.lit(3)}
    return rows.select(*[F.col(f.name) if f.name in rows.columns else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION_SCHEMA])


def test_parts_are_packed(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    part = store.put_transactions(transactions(make), 0)
    assert any(name.endswith(".zstd.parquet") for name in names_in(spark, store.path(part.path)))


def test_two_parts_by_day_are_read_together(spark, make, tmp_path):
    store = Store(spark, str(tmp_path), day_bytes=1)
    for batch_id in (0, 1):
        store.write_transactions(transactions(make, source_id=f"id-{batch_id}"), batch_id)
        store.compact_transactions(batch_id)
    assert [p.key for p in store.parts("transactions")] == [BY_DAY, BY_DAY]
    assert sorted(r.source_id for r in store.transactions().collect()) == ["id-0", "id-1"]


def test_copies_are_told_by_their_numbers(spark, make, tmp_path):
    rows = ingest.in_order(make(*[{"source_id": s} for s in "aabca"]))
    path = str(tmp_path / "firsts")
    dedup.first_rows(rows, "source_id").write.parquet(path)
    firsts = spark.read.parquet(path)
    known = spark.createDataFrame([("c",)], "key string")
    again = dedup.repeated_rows(rows, firsts, known)
    assert again.count() == 3  # two more a, and the c that was seen before
    left = dedup.without_rows(rows, again)
    assert sorted((r.source_id, r.arrival_seq.arrival_seq) for r in left.collect()) == [("a", 0), ("b", 2)]


def test_many_copies_move_no_row(spark, make):
    """Numbers that go are broadcast as bits, also where a table of them is no longer small."""
    rows = ingest.in_order(make(*[{"source_id": f"id-{n % 700}"} for n in range(5000)]).repartition(3))
    rows = ingest.stage(rows, "rows")[0]
    gone = dedup.repeated_rows(rows, dedup.first_rows(rows, "source_id"), n_rows=5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = dedup.without_rows(rows.select("arrival_seq", "source_id"), gone, 5000)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == left.select("source_id").distinct().count() == 700
        assert left.where("arrival_seq.arrival_seq >= 700").count() == 0
        assert dedup.without_rows(rows, gone).count() == 700  # by any join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_invalid_rows_are_not_staged_unless_they_hide_others(make):
    rows = make({}, {"amount": "-1.00"}, {"amount": "-1.00"}).withColumn("record_key", F.when(F.col("arrival_seq") == 2, "evt"))
    kept = accepted.worth_staging(rows, validate.ingest_rules())
    assert sorted(r.arrival_seq for r in kept.collect()) == [0, 2]
    assert accepted.worth_staging(rows.drop("record_key"), validate.ingest_rules()).count() == 1


def test_labelled_rows_are_computed_once_to_fit(spark):
    """Whatever passes the training makes, it reads the merged samples."""
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("gold ring", "rings"), ("steel bolt", "bolts")] * 5, "merchant_name string, category_code string")
    classify.fit_text_model(rows.mapInArrow(count, rows.schema))
    assert asked.value == 10


def test_event_fields_come_of_one_parse(spark):
    value = '{"source_id":"a","amount":15702.0300,"raw_payload":"{\\"amount\\":1}","category_code":null,"account_id":"\\u00e9\\""}'
    events = spark.createDataFrame([("a", value), ("b", None), ("c", "oops")], "key string, value string")
    fields = entry._event_fields(events, "source_id", "account_id", "amount", "category_code", "category_tier")
    assert plan(fields).count("json_tuple") == 1 and "get_json_object" not in plan(fields)
    got = {r.key: tuple(r)[1:] for r in fields.collect()}
    assert got == {"a": ("a", 'é"', Decimal("15702.0300"), None, None), "b": (None,) * 5, "c": (None,) * 5}


def test_records_sent_again_are_not_copied(spark, tmp_path):
    """Files that get another name are new to a stream on the same checkpoint."""
    folder, seen = str(tmp_path / "raw"), []
    spark.range(5).write.parquet(f"{folder}/after0")
    for again in (None, "after23", "after25"):
        if again:
            renamed(spark, f"{folder}/{before}", f"{folder}/{again}")
        before = again or "after0"
        stream = spark.readStream.schema("id long").parquet(f"{folder}/*")
        job = stream.writeStream.foreachBatch(lambda rows, _: seen.append(rows.count()))
        job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert names_in(spark, folder) == [before]
    assert seen == [5, 5, 5]
    with pytest.raises((OSError, Py4JJavaError)):
        renamed(spark, f"{folder}/gone", f"{folder}/other")


def test_batches_of_the_windowed_rollup_are_bounded(spark, monkeypatch):
    """However many files there are; their sums add up to the same rollup."""
    started = []
    real = entry.stream_rollup.start_windowed_rollup

    def start(stream, *args):
        job = real(stream, *args)
        started.append(job)
        return job

    monkeypatch.setattr(entry.stream_rollup, "start_windowed_rollup", start)
    monkeypatch.setattr(entry, "MOST_BATCHES", 2)
    spread = entry.tb.transactions
    monkeypatch.setattr(entry.tb, "transactions", lambda *args: spread(*args).repartition(9))
    rows = {tuple(r) for r in entry.windowed_rollup(spark, "/root/testdata/sf0.001").collect()}
    assert started[0].lastProgress["batchId"] == 1  # 9 files in two batches, and not five
    monkeypatch.undo()
    assert rows == {tuple(r) for r in entry.rollup_weekly(spark, "/root/testdata/sf0.001").collect()}


def test_payment_steps_are_landed_by_one_write(spark, monkeypatch):
    """Both steps come of one reading of the events."""
    real = entry.tb.payment_lifecycles

    def lifecycles(*args):
        rows = real(*args)
        return rows.withColumn("payment_id", counted(rows["payment_id"]))

    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        asked.add(1)
        return value

    monkeypatch.setattr(entry.tb, "payment_lifecycles", lifecycles)
    sf = "/root/testdata/sf0.001"
    written = entry._payment_lifecycles(spark, sf).outcomes().agg(F.sum("records")).first()[0]
    assert asked.value == written == real(spark, sf).count()
