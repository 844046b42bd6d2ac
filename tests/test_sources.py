import json
from datetime import datetime
from decimal import Decimal

import pytest

from centsible.operators.validate import structural_rules
from centsible.schemas import BANK_FEED, BANK_SCHEMA, CARD_NETWORK, CARD_SCHEMA, PAYMENT_PROCESSOR, PAYMENT_SCHEMA
from centsible.sources import adapters
from centsible.sources.readers import parse_events, read_records

AT = datetime(2024, 3, 15, 11, 0)
CLEARED = datetime(2024, 3, 15, 11, 30)


def bank(spark, **changes):
    row = dict(
        transaction_id="BF-12345",
        account_id="ACC-0001",
        merchant_name="Test Merchant",
        amount=Decimal("100.50"),
        currency="ZAR",
        transacted_at=AT,
        status="SETTLED",
    )
    return spark.createDataFrame([tuple({**row, **changes}.values())], BANK_SCHEMA)


def payment(spark, **changes):
    row = dict(
        event_id="evt_12345",
        event_type="payment_intent.succeeded",
        payment_id="pi_12345",
        customer_id="cus_001",
        merchant_descriptor="Test Merchant",
        amount=Decimal("100.50"),
        currency="ZAR",
        created_at=AT,
        retry_attempt=0,
    )
    return spark.createDataFrame([tuple({**row, **changes}.values())], PAYMENT_SCHEMA)


def card(spark, **changes):
    row = dict(
        record_id="CN-12345",
        auth_code="AUTH123",
        pan_last_four="1234",
        merchant_name="Test Merchant",
        merchant_city="Test City",
        mcc="5411",
        amount=Decimal("100.50"),
        currency="ZAR",
        authorised_at=AT,
        cleared_at=CLEARED,
        clearing_status="CLEARED",
    )
    return spark.createDataFrame([tuple({**row, **changes}.values())], CARD_SCHEMA)


def test_bank_fields(spark):
    row = adapters.normalise(bank(spark), BANK_FEED).first()
    assert (row.source_id, row.source_type, row.account_id) == ("BF-12345", "BANK_FEED", "ACC-0001")
    assert (row.amount, row.currency, row.merchant_mcc) == (Decimal("100.5000"), "ZAR", None)
    assert (row.transacted_at, row.status) == (AT, "SETTLED")


@pytest.mark.parametrize("status, expected", [("PENDING", "PENDING"), ("REVERSED", "REVERSED"), ("ODD", None)])
def test_bank_status(spark, status, expected):
    assert adapters.normalise_bank(bank(spark, status=status)).first().status == expected


@pytest.mark.parametrize(
    "event_type, expected",
    [
        ("payment_intent.succeeded", "SETTLED"),
        ("payment_intent.created", "PENDING"),
        ("charge.refunded", "REVERSED"),
        ("charge.disputed", "PENDING"),
        (None, "PENDING"),
    ],
)
def test_payment_status(spark, event_type, expected):
    row = adapters.normalise_payment(payment(spark, event_type=event_type)).first()
    assert row.status == expected
    assert (row.source_id, row.account_id, row.merchant_mcc) == ("pi_12345", "cus_001", None)


@pytest.mark.parametrize(
    "word, expected", [("CLEARED", "SETTLED"), ("AUTH", "PENDING"), ("REVERSED", "REVERSED"), ("X", "PENDING")]
)
def test_card_status(spark, word, expected):
    row = adapters.normalise_card(card(spark, clearing_status=word)).first()
    assert (row.status, row.merchant_mcc, row.account_id) == (expected, "5411", "1234")


def test_card_time_is_clearing_else_authorisation(spark):
    assert adapters.normalise_card(card(spark)).first().transacted_at == CLEARED
    assert adapters.normalise_card(card(spark, cleared_at=None)).first().transacted_at == AT


def test_payload_keeps_the_whole_record(spark):
    payload = json.loads(adapters.normalise_card(card(spark, cleared_at=None)).first().raw_payload)
    assert payload["merchant_city"] == "Test City" and payload["record_id"] == "CN-12345"
    assert "cleared_at" in payload and payload["cleared_at"] is None


def test_union_of_sources(spark):
    raw = {BANK_FEED: bank(spark), PAYMENT_PROCESSOR: payment(spark), CARD_NETWORK: card(spark)}
    types = {r.source_type for r in adapters.normalise_all(raw).collect()}
    assert types == {BANK_FEED, PAYMENT_PROCESSOR, CARD_NETWORK}


def test_another_source_can_be_registered(spark):
    adapters.register_adapter("LEDGER", adapters.SourceAdapter(adapters.normalise_bank, "transaction_id"))
    try:
        assert adapters.normalise(bank(spark), "LEDGER").count() == 1
        assert ("source_type_unknown", "NOT coalesce(source_type IN ('BANK_FEED', 'PAYMENT_PROCESSOR', 'CARD_NETWORK', 'LEDGER'), false)") in structural_rules()
    finally:
        del adapters.ADAPTERS["LEDGER"]


def test_reader_ignores_unknown_fields_and_nulls_bad_values(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"transaction_id":"BF-1","account_id":"A","merchant_name":"M","amount":"12.5","currency":"ZAR",'
        '"transacted_at":"2024-03-15T11:00:00Z","status":"SETTLED","colour":"red"}\n'
        '{"transaction_id":"BF-2","amount":"much","status":"SETTLED"}\n'
        "no json at all\n"
    )
    raw = read_records(spark, BANK_FEED, str(tmp_path))
    rows = {r.source_id: r for r in adapters.normalise_bank(raw).collect()}
    assert rows["BF-1"].amount == Decimal("12.5000") and rows["BF-1"].ingested_at is not None
    assert rows["BF-2"].amount is None
    assert None in rows


def test_topic_events(spark, make):
    from centsible.sources.tables import accepted_events

    events = accepted_events(make({"source_id": "k1", "amount": "7.25"}))
    half = '{"source_id":"k3","amount":"oops","status":"SETTLED","raw_payload":"{}"}'
    broken = spark.createDataFrame([("k2", "{not json"), ("k3", half)], "key string, value string")
    rows = {r.source_id: r for r in parse_events(events.unionByName(broken)).collect()}
    assert rows["k3"].raw_payload == half and rows["k3"].amount is None and rows["k3"].ingested_at is not None
    assert rows["k1"].amount == Decimal("7.2500") and rows["k1"].merchant_name == "Some Merchant"
    assert rows[None].raw_payload == "{not json"
