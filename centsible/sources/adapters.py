"""Raw source records -> canonical transactions.

An adapter is a function ``DataFrame -> DataFrame`` kept in ``ADAPTERS`` under its
source type; register another one to add a source. Adapters only rename and map, so they
run inside the scan stage of a batch or a stream. Arrival columns (``ingested_at``,
``arrival_seq``) are carried along when the input has them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from centsible.functions.status import bank_status, card_status, payment_status
from centsible.schemas import (
    BANK_FEED,
    CARD_NETWORK,
    NORMALISED_SCHEMA,
    PAYMENT_PROCESSOR,
    SOURCE_SCHEMAS,
)

# record_key is the raw key that the ingest job checks, seen_at the clock of the streaming check
ARRIVAL_COLUMNS = ("ingested_at", "arrival_seq", "record_key", "seen_at")


def _canonical(raw: DataFrame, source_type: str, mapping: Mapping[str, str]) -> DataFrame:
    """Map SQL expressions to the canonical columns and keep the whole source record as JSON
    (``{}`` when it cannot be written)."""
    record = ", ".join(SOURCE_SCHEMAS[source_type].names)
    payload = f"coalesce(to_json(struct({record}), map('ignoreNullFields', 'false')), '{{}}')"
    mapping = {**mapping, "source_type": f"'{source_type}'", "raw_payload": payload}
    arrival = [name for name in ARRIVAL_COLUMNS if name in raw.columns]
    return raw.selectExpr(*[f"{mapping[name]} AS {name}" for name in NORMALISED_SCHEMA.names], *arrival)


def normalise_bank(raw: DataFrame) -> DataFrame:
    """Bank feed: no MCC; a status word outside the three known ones is an error."""
    return _canonical(
        raw,
        BANK_FEED,
        {
            "source_id": "transaction_id",
            "account_id": "account_id",
            "amount": "amount",
            "currency": "currency",
            "merchant_name": "merchant_name",
            "merchant_mcc": "CAST(NULL AS STRING)",
            "transacted_at": "transacted_at",
            "status": bank_status("status"),
        },
    )


def normalise_payment(raw: DataFrame) -> DataFrame:
    """Payment event: no MCC; the payment id, not the event id, identifies the transaction."""
    return _canonical(
        raw,
        PAYMENT_PROCESSOR,
        {
            "source_id": "payment_id",
            "account_id": "customer_id",
            "amount": "amount",
            "currency": "currency",
            "merchant_name": "merchant_descriptor",
            "merchant_mcc": "CAST(NULL AS STRING)",
            "transacted_at": "created_at",
            "status": payment_status("event_type"),
        },
    )


def normalise_card(raw: DataFrame) -> DataFrame:
    """Card settlement: MCC kept; clearing time when there is one, else authorisation time."""
    return _canonical(
        raw,
        CARD_NETWORK,
        {
            "source_id": "record_id",
            "account_id": "pan_last_four",
            "amount": "amount",
            "currency": "currency",
            "merchant_name": "merchant_name",
            "merchant_mcc": "mcc",
            "transacted_at": "coalesce(cleared_at, authorised_at)",
            "status": card_status("clearing_status"),
        },
    )


@dataclass(frozen=True)
class SourceAdapter:
    """How one source is normalised, which raw column says a record was seen before, the schema of
    its records, and validation rules ``(reason, SQL condition that breaks it)`` of its own."""

    normalise: Callable[[DataFrame], DataFrame]
    record_key: str
    schema: StructType | None = None
    rules: tuple[tuple[str, str], ...] = ()


ADAPTERS: dict[str, SourceAdapter] = {
    BANK_FEED: SourceAdapter(normalise_bank, "transaction_id", SOURCE_SCHEMAS[BANK_FEED]),
    PAYMENT_PROCESSOR: SourceAdapter(normalise_payment, "event_id", SOURCE_SCHEMAS[PAYMENT_PROCESSOR]),
    CARD_NETWORK: SourceAdapter(normalise_card, "record_id", SOURCE_SCHEMAS[CARD_NETWORK]),
}


def register_adapter(source_type: str, adapter: SourceAdapter) -> None:
    """Add a source: its records are normalised, known to validation and judged by the adapter's rules."""
    ADAPTERS[source_type] = adapter


def unregister_adapter(source_type: str) -> None:
    """Forget a source that was added."""
    del ADAPTERS[source_type]


def normalise(raw: DataFrame, source_type: str) -> DataFrame:
    return ADAPTERS[source_type].normalise(raw)


def union_sources(normalised: list[DataFrame]) -> DataFrame:
    """Fan several normalised sources into one canonical DataFrame."""
    return reduce(DataFrame.unionByName, normalised)


def normalise_all(raw_by_source: Mapping[str, DataFrame]) -> DataFrame:
    return union_sources([normalise(raw, source) for source, raw in raw_by_source.items()])
