"""Validation: every rule is one boolean column, so a scan-stage filter decides each row.

Rules are a list of ``(reason, broken)`` pairs, the second being a SQL condition. Valid rows are selected by one small condition
per rule, which Spark pushes down on its own; the reasons are computed for rejected rows only.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.functions.text import is_blank
from centsible.schemas import CARD_NETWORK, CURRENCIES, PAYMENT_PROCESSOR, REVERSED, STATUSES
from centsible.sources.adapters import ADAPTERS

Rule = tuple[str, str]  # reason, SQL condition that breaks it (null means not broken)

# Fixed values.
CLOCK_SKEW_MINUTES = 5
MAX_AGE_DAYS = 7
MAX_AMOUNT = Decimal("100000.00")
LARGE_REVERSAL_AMOUNT = Decimal("50000.00")


def _unless(known: str) -> str:
    """True unless the test is surely true (null counts as broken)."""
    return f"NOT coalesce({known}, false)"


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(value) for value in values)})"


def structural_rules() -> list[Rule]:
    """What every canonical transaction must have. The known sources are the registered ones."""
    return [
        ("source_id_blank", is_blank("source_id")),
        ("source_type_unknown", _unless(_one_of("source_type", tuple(ADAPTERS)))),
        ("account_id_blank", is_blank("account_id")),
        ("amount_not_positive", _unless("amount > 0")),
        ("currency_missing", _unless(_one_of("currency", CURRENCIES))),
        ("merchant_name_blank", is_blank("merchant_name")),
        ("transacted_at_missing", "transacted_at IS NULL"),
        ("status_unknown", _unless(_one_of("status", STATUSES))),
    ]


def source_rules() -> list[Rule]:
    """What one source asks for beyond the structural rules. Bank feeds need a currency and a
    time and payments an account, which the structural rules already cover. A registered source
    brings its own."""
    own = [
        (reason, f"source_type = '{source}' AND ({broken})")
        for source, adapter in ADAPTERS.items()
        for reason, broken in adapter.rules
    ]
    return own + [
        ("card_mcc_blank", f"source_type = '{CARD_NETWORK}' AND {is_blank('merchant_mcc')}"),
        ("payment_account_blank", f"source_type = '{PAYMENT_PROCESSOR}' AND {is_blank('account_id')}"),
    ]


def business_rules(
    as_of: datetime | str | None = None,
    clock_skew_minutes: int = CLOCK_SKEW_MINUTES,
    max_age_days: int | None = MAX_AGE_DAYS,
    max_amount: Decimal | None = MAX_AMOUNT,
) -> list[Rule]:
    """Limits relative to the moment of ingest; the bounds themselves are allowed and ``None``
    switches a limit off.

    ``as_of`` is a time or a SQL expression. By default it is the record's own arrival time,
    which, unlike the current time, gives the same verdict when a batch is replayed.
    """
    if as_of is None:
        as_of = "ingested_at"
    elif isinstance(as_of, datetime):
        as_of = f"TIMESTAMP '{as_of}'"
    rules = [("in_future", f"transacted_at > {as_of} + INTERVAL {clock_skew_minutes} MINUTES")]
    if max_age_days is not None:
        rules.append(("too_old", f"transacted_at < {as_of} - INTERVAL {max_age_days * 24} HOURS"))
    if max_amount is not None:
        rules.append(("amount_too_large", f"amount > {max_amount}"))
    return rules


def ingest_rules(as_of: datetime | str | None = None, **limits) -> list[Rule]:
    """All rules in the order they are reported; ``limits`` are those of ``business_rules``."""
    return structural_rules() + source_rules() + business_rules(as_of, **limits)


def all_hold(rules: list[Rule]) -> Column:
    """True for a row that breaks no rule."""
    return F.expr(" AND ".join(f"NOT coalesce({broken}, false)" for _, broken in rules))


def valid_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break no rule."""
    return df.where(all_hold(rules))


def reasons_of(rules: Iterable[Rule]) -> str:
    """SQL array of the reasons of all broken rules, without a function that takes a lambda: those are not compiled, and
    neither would be the rules inside."""
    reasons = ", ".join(f"CASE WHEN {broken} THEN '{reason}' ELSE '' END" for reason, broken in rules)
    return f"array_remove(array({reasons}), '')"


def with_reject_reasons(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``reject_reason`` (the first broken rule, null for a valid row) and
    ``reject_reasons`` (all of them)."""
    judged = df.selectExpr("*", f"{reasons_of(rules)} AS _reasons")  # each rule is looked at once
    return judged.selectExpr(*[f"`{name}`" for name in df.columns], "get(_reasons, 0) AS reject_reason", "_reasons AS reject_reasons")


def rejected_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break a rule, with their reasons. The rows are chosen by the conditions alone."""
    broken = df.where(" OR ".join(f"coalesce({broken}, false)" for _, broken in rules))
    return with_reject_reasons(broken, rules)


def is_large_reversal() -> Column:
    """A reversal above the limit is allowed but worth a look."""
    return F.expr(f"coalesce(status = '{REVERSED}' AND amount > {LARGE_REVERSAL_AMOUNT}, false)")
