"""Source status words -> PENDING / SETTLED / REVERSED, as SQL expressions over a column."""

from __future__ import annotations

from collections.abc import Mapping

from centsible.schemas import PENDING, REVERSED, SETTLED, STATUSES

# Fixed values.
PAYMENT_EVENT_STATUS = {
    "payment_intent.succeeded": SETTLED,
    "payment_intent.created": PENDING,
    "charge.refunded": REVERSED,
}
CARD_CLEARING_STATUS = {
    "CLEARED": SETTLED,
    "AUTH": PENDING,
    "REVERSED": REVERSED,
}


def translate(column: str, words: Mapping[str, str], otherwise: str = "NULL") -> str:
    """A CASE expression that replaces words; ``otherwise`` is SQL for all other values."""
    arms = " ".join(f"WHEN '{word}' THEN '{meaning}'" for word, meaning in words.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def payment_status(column: str) -> str:
    return translate(column, PAYMENT_EVENT_STATUS, f"'{PENDING}'")


def card_status(column: str) -> str:
    return translate(column, CARD_CLEARING_STATUS, f"'{PENDING}'")


def bank_status(column: str) -> str:
    """Bank status words are already canonical; any other word becomes null and is rejected."""
    return translate(column, {status: status for status in STATUSES})
