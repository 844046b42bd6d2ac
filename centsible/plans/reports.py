"""Operational reports: ingest outcomes and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.schemas import ACCEPTED, DUPLICATE


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Records per source and outcome over all stored batches."""
    return outcomes.groupBy("source_type", "outcome").agg(F.sum("records").alias("records"))


def processing_counters(outcomes: DataFrame) -> DataFrame:
    """Records per source, as successes (accepted or known already) and failures."""
    result = F.when(F.col("outcome").isin(ACCEPTED, DUPLICATE), "success").otherwise("failure")
    return outcomes.groupBy("source_type", result.alias("result")).agg(
        F.sum("records").alias("records")
    )


def dead_letter_report(dead_letters: DataFrame) -> DataFrame:
    """Dead letters per source and broken rule; a row that breaks two rules counts for both."""
    return (
        # outer: else Spark asks for a size above 0 before it, and judges every record once more for that
        dead_letters.select("source_type", F.explode_outer("reject_reasons").alias("reason"))
        .where("reason IS NOT NULL")
        .groupBy("source_type", "reason")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def dead_letter_context(dead_letters: DataFrame) -> DataFrame:
    """What an investigator needs of each record."""
    return dead_letters.select(
        "source_id",
        "source_type",
        "account_id",
        "amount",
        "currency",
        "status",
        "origin",
        "stage",
        "batch_id",
        F.array_join("reject_reasons", ",").alias("failure_cause"),
    )

