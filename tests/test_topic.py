"""Broken and sound topic events are judged side by side."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from centsible.sources.readers import parse_events

SF_DIR = "/root/testdata/sf0.001"


def test_damage_to_sound_events_shows(spark, monkeypatch):
    def damaging(events):
        lost = F.when(~F.expr("endswith(source_id, '6')"), F.col("currency"))
        return parse_events(events).withColumn("currency", lost)

    monkeypatch.setattr(entry, "parse_events", damaging)
    letters = entry.queries()["topic_bad_field"](spark, SF_DIR).collect()
    assert {r.reject_reason for r in letters if r.source_id.endswith("6")} == {"currency_missing"}


def test_every_event_is_judged(spark):
    judged = entry.queries()["topic_outcomes"](spark, SF_DIR)
    assert judged.count() == entry.queries()["topic_round_trip"](spark, SF_DIR).count()
    assert {r.reject_reason for r in judged.collect()} == {None, "amount_not_positive"}
