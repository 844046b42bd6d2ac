from datetime import timedelta

import pytest

from centsible.operators.validate import (
    ingest_rules,
    is_large_reversal,
    rejected_rows,
    valid_rows,
    with_reject_reasons,
)
from tests.conftest import AS_OF

RULES = ingest_rules(AS_OF)


def reasons(make, **record):
    return with_reject_reasons(make(record), RULES).first().reject_reasons


@pytest.mark.parametrize(
    "record, expected",
    [
        ({}, []),
        ({"transacted_at": AS_OF + timedelta(minutes=3)}, []),
        ({"transacted_at": AS_OF + timedelta(minutes=5)}, []),
        ({"transacted_at": AS_OF + timedelta(minutes=5, seconds=1)}, ["in_future"]),
        ({"transacted_at": AS_OF + timedelta(minutes=10)}, ["in_future"]),
        ({"transacted_at": AS_OF - timedelta(days=7)}, []),
        ({"transacted_at": AS_OF - timedelta(days=8)}, ["too_old"]),
        ({"amount": "100000.00"}, []),
        ({"amount": "100000.01"}, ["amount_too_large"]),
        ({"amount": "0.00"}, ["amount_not_positive"]),
        ({"amount": "-1"}, ["amount_not_positive"]),
        ({"amount": None}, ["amount_not_positive"]),
        ({"source_id": None}, ["source_id_blank"]),
        ({"source_id": " \t"}, ["source_id_blank"]),
        ({"source_id": " \n"}, ["source_id_blank"]),
        ({"account_id": ""}, ["account_id_blank"]),
        ({"account_id": "", "source_type": "PAYMENT_PROCESSOR"}, ["account_id_blank", "payment_account_blank"]),
        ({"currency": None}, ["currency_missing"]),
        ({"currency": "rand"}, ["currency_missing"]),
        ({"currency": "QQQ"}, ["currency_missing"]),
        ({"currency": "ZAR\n"}, ["currency_missing"]),
        ({"merchant_name": "  "}, ["merchant_name_blank"]),
        ({"transacted_at": None}, ["transacted_at_missing"]),
        ({"status": None}, ["status_unknown"]),
        ({"source_type": "FAX"}, ["source_type_unknown"]),
        ({"source_type": "CARD_NETWORK"}, ["card_mcc_blank"]),
        ({"source_type": "CARD_NETWORK", "merchant_mcc": " "}, ["card_mcc_blank"]),
        ({"source_type": "CARD_NETWORK", "merchant_mcc": "5411"}, []),
        ({"amount": None, "currency": None}, ["amount_not_positive", "currency_missing"]),
    ],
)
def test_rules(make, record, expected):
    assert reasons(make, **record) == expected
    assert valid_rows(make(record), RULES).count() == (0 if expected else 1)
    rejected = rejected_rows(make(record), RULES).collect()
    assert [r.reject_reason for r in rejected] == expected[:1]


def test_arrival_time_is_the_default_clock(make):
    old = {"transacted_at": AS_OF - timedelta(days=30), "ingested_at": AS_OF - timedelta(days=30)}
    late = {"transacted_at": AS_OF - timedelta(days=30)}
    assert [r.source_id for r in valid_rows(make(old, late), ingest_rules()).collect()] == ["id-0"]


def test_limits_can_be_switched_off(make):
    rules = ingest_rules(AS_OF, max_age_days=None, max_amount=None)
    record = {"amount": "999999", "transacted_at": AS_OF - timedelta(days=4000)}
    assert valid_rows(make(record), rules).count() == 1


@pytest.mark.parametrize(
    "record, flagged",
    [
        ({"status": "REVERSED", "amount": "50000.01"}, True),
        ({"status": "REVERSED", "amount": "50000.00"}, False),
        ({"status": "SETTLED", "amount": "60000.00"}, False),
        ({"status": None, "amount": "60000.00"}, False),
    ],
)
def test_large_reversal_is_flagged_not_rejected(make, record, flagged):
    assert make(record).select(is_large_reversal().alias("f")).first().f is flagged
