"""Batch form of the ingest path: raw sources -> stored transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from centsible.operators.categorise import Classifier, categorise
from centsible.operators.dedup import drop_source_repeats, first_wins, first_wins_written
from centsible.operators.validate import ingest_rules, valid_rows
from centsible.schemas import PAYMENT_PROCESSOR
from centsible.sources.adapters import normalise_all
from centsible.sources.tables import to_transactions


def normalised(raw_by_source: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as canonical rows. Only payments need the check on the raw key: for bank
    and card records the raw key is the source id, which is checked after validation."""
    checked = {
        source: drop_source_repeats(raw, source) if source == PAYMENT_PROCESSOR else raw
        for source, raw in raw_by_source.items()
    }
    return normalise_all(checked)


def ingest(
    raw_by_source: Mapping[str, DataFrame],
    categories: DataFrame,
    as_of=None,
    classifier: Classifier | None = None,
    written: bool = False,
    **limits,
) -> DataFrame:
    """Validate, keep the first row of every source id, categorise and shape for storage. ``written`` is for results that are
    stored with all columns: the valid rows are written at once, instead of being shuffled whole."""
    valid = valid_rows(normalised(raw_by_source), ingest_rules(as_of, **limits))
    accepted = (first_wins_written if written else first_wins)(valid, "source_id")
    return to_transactions(categorise(accepted, categories, classifier))
