
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date, timedelta
from decimal import Decimal
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracle  # noqa: E402
from centsible import testbed as tb  # noqa: E402
from centsible.operators import categorise as cg  # noqa: E402
from centsible.operators import classify, dedup, paging, rollup, validate  # noqa: E402
from centsible.plans import categories as pc  # noqa: E402
from centsible.plans import compare, reports, spending  # noqa: E402
from centsible.plans import transactions as pt  # noqa: E402
from centsible.plans.ingest import ingest as batch_ingest  # noqa: E402
from centsible.schemas import BANK_SCHEMA, CARD_NETWORK, DAILY, MONTHLY, PAYMENT_PROCESSOR, WEEKLY  # noqa: E402
from centsible.session import prepare, scratch_path, setting  # noqa: E402
from centsible.sources import tables  # noqa: E402
from centsible.sources.manifest import names_in, renamed  # noqa: E402
from centsible.sources.adapters import SourceAdapter, normalise, register_adapter, unregister_adapter  # noqa: E402
from centsible.sources.categories import load_categories  # noqa: E402
from centsible.sources.readers import parse_events, stream_records  # noqa: E402
from centsible.streaming import accepted, ingest  # noqa: E402
from centsible.streaming.counters import Counters  # noqa: E402
from centsible.streaming import rollup as stream_rollup  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

CANONICAL = [
    "source_id",
    "source_type",
    "account_id",
    "amount",
    "currency",
    "merchant_name",
    "merchant_mcc",
    "transacted_at",
    "status",
]
ROLLUP = [
    "account_id",
    "category_id",
    "period_date",
    "period_type",
    "total_spend",
    "transaction_count",
    "total_reversed",
]
#: A streaming query over files of its own takes so many batches at most.
MOST_BATCHES = 8
YEAR_1998 = compare.ComparisonRequest(date(1998, 1, 1), date(1998, 12, 31))
YEAR_1998_BY_MONTH = compare.ComparisonRequest(date(1998, 1, 1), date(1998, 12, 31), period_type=MONTHLY)


def present(df: DataFrame) -> DataFrame:
    """Types both engines print alike; used on results only, all arithmetic is exact before."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# ---- sources -------------------------------------------------------------------------------


def normalise_card(spark, sf):
    return normalise(tb.card_records(spark, sf), CARD_NETWORK).select(*CANONICAL)


def normalise_bank(spark, sf):
    return normalise(tb.bank_records(spark, sf), "BANK_FEED").select(*CANONICAL)


def normalise_payment(spark, sf):
    return normalise(tb.payment_events(spark, sf), PAYMENT_PROCESSOR).select(*CANONICAL)


def unified_transactions(spark, sf):
    return tb.unified(spark, sf).select(*CANONICAL)


def payload_field_query(spark, sf):
    fields = {"city": "$.merchant_city", "auth_code": "$.auth_code", "event_type": "$.event_type"}
    return pt.payload_fields(tb.transactions(spark, sf), **fields)


def stored_payload_query(spark, sf):
    """The same fields from source records that were parsed once, when they were stored."""
    store = tables.Store(spark, scratch_path(spark, "payloads"))
    store.manifest.commit([store.put_payloads(tb.transactions(spark, sf), 0)])
    fields = {"city": "$.merchant_city", "auth_code": "$.auth_code", "event_type": "$.event_type"}
    return pt.stored_payload_fields(store.payloads(), **fields)


# ---- validation and dedup ------------------------------------------------------------------


def _rules():
    """Payments are judged at one moment, everything else when it arrived."""
    clock = (
        f"CASE WHEN source_type = '{PAYMENT_PROCESSOR}' THEN TIMESTAMP '{tb.PAYMENTS_AS_OF}' ELSE ingested_at END"
    )
    return validate.ingest_rules(clock)


def _rejected(spark, sf):
    return validate.rejected_rows(tb.unified(spark, sf), _rules())


def _valid_any_age(spark, sf):
    return validate.valid_rows(tb.unified(spark, sf), validate.ingest_rules(max_age_days=None))


def validation_rejects(spark, sf):
    return _rejected(spark, sf).select(
        "source_id",
        "source_type",
        "amount",
        "transacted_at",
        "reject_reason",
        F.array_join("reject_reasons", ",").alias("reject_reasons"),
    )


def large_reversals(spark, sf):
    flagged = tb.unified(spark, sf).where(validate.is_large_reversal())
    judged = validate.with_reject_reasons(flagged, _rules())
    return judged.select("source_id", "amount", F.col("reject_reason").isNotNull().alias("is_rejected"))


def ingest_outcomes(spark, sf):
    rows = tb.unified(spark, sf).drop("raw_payload")  # neither a rule nor the result looks at it
    outcomes = dedup.classify_outcomes(rows, _rules())
    return outcomes.select("source_id", "amount", "outcome")


def ingest_report(spark, sf):
    return reports.ingest_report(dedup.count_outcomes(tb.unified(spark, sf), _rules()))


def processing_counters(spark, sf):
    outcomes = dedup.count_outcomes(tb.unified(spark, sf), _rules())
    return reports.processing_counters(outcomes)


def dedup_first_wins(spark, sf):
    return dedup.first_wins(_valid_any_age(spark, sf), "source_id").select(*CANONICAL)


def source_repeats(spark, sf):
    firsts = dedup.drop_source_repeats(tb.card_records(spark, sf), CARD_NETWORK)
    return firsts.select("record_id", "pan_last_four", "merchant_name", "amount")


def drop_stored(spark, sf):
    """Rows whose id was not seen before in a record below 50000."""
    valid = _valid_any_age(spark, sf)
    stored = valid.where("amount < 50000").select("source_id")
    return dedup.drop_stored(dedup.first_wins(valid, "source_id"), stored, keys=valid).select(*CANONICAL)


def _dead_letters(spark, sf):
    return tables.to_dead_letters(_rejected(spark, sf))


def dead_letter_report(spark, sf):
    return reports.dead_letter_report(_dead_letters(spark, sf))


def dead_letter_context(spark, sf):
    return reports.dead_letter_context(_dead_letters(spark, sf)).drop("origin")


def _distorted(spark, sf):
    """All sources with one field blanked or distorted, chosen by the last digit of the source id."""
    digit = F.substring("source_id", -1, 1)
    change = {
        "0": ("source_id", F.lit(" ")),
        "1": ("account_id", F.lit("")),
        "2": ("currency", F.lit("QQQ")),
        "3": ("merchant_name", F.lit(None).cast("string")),
        "4": ("transacted_at", F.lit(None).cast("timestamp")),
        "5": ("status", F.lit("ODD")),
        "6": ("source_type", F.lit("UNHEARD_OF")),
        "7": ("merchant_mcc", F.lit("\t")),
        "8": ("amount", -F.col("amount")),
    }
    broken = {name: F.when(digit == d, value).otherwise(F.col(name)) for d, (name, value) in change.items()}
    return tb.unified(spark, sf).withColumns(broken)


def validation_all_rules(spark, sf):
    """How often each of the rules fires on records that break them all."""
    rejected = validate.rejected_rows(_distorted(spark, sf), _rules())
    return reports.dead_letter_report(tables.to_dead_letters(rejected))


def registered_source_ingest(spark, sf):
    """A source that is not built in: bank records as a ledger of its own, with a rule of its own."""

    def normalise_ledger(raw):
        return normalise(raw, "BANK_FEED").withColumn("source_type", F.lit("LEDGER"))

    rules = (("ledger_amount_too_small", "amount < 1000"),)
    register_adapter("LEDGER", SourceAdapter(normalise_ledger, "transaction_id", BANK_SCHEMA, rules))
    try:
        stored = batch_ingest({"LEDGER": tb.bank_records(spark, sf)}, tb.categories(spark), max_age_days=None)
    finally:
        unregister_adapter("LEDGER")  # its rules are in the plan by now
    return stored.select(*CANONICAL)


# ---- categorisation ------------------------------------------------------------------------


def categorise_mcc(spark, sf):
    firsts = dedup.first_wins(_valid_any_age(spark, sf), "source_id")
    return cg.match_mcc(firsts, tb.categories(spark)).select("source_id", "merchant_mcc", "mcc_category_id")


def categorise_keyword(spark, sf):
    firsts = dedup.first_wins(_valid_any_age(spark, sf), "source_id")
    matched = cg.match_keyword(firsts, tb.categories(spark))
    return matched.select("source_id", "merchant_name", "keyword_category_id")


def categorise_tiers(spark, sf):
    return tb.transactions(spark, sf).select("source_id", "category_id", "category_tier")


def _widget_model(requests):
    """Says "plates" for small widget purchases and an unknown code for large ones."""
    codes = requests["amount"].astype("float64").le(50000).map({True: "plates", False: "no_such_code"})
    widget = requests["merchant_name"].str.contains("widget")
    return requests.assign(code=codes.where(widget), confidence=0.9)


def python_classifier(spark, sf):
    model = classify.python_classifier(_widget_model)
    return tb.transactions(spark, sf, model).select("source_id", "category_id", "category_tier")


def ml_fallback(spark, sf):
    """Text model fitted on the rows a rule labelled, applied to those without a rule."""
    labelled = cg.with_category(tb.transactions(spark, sf).where("category_tier = 'rules'"), tb.categories(spark))
    model = classify.model_classifier(classify.fit_text_model(labelled))
    return tb.transactions(spark, sf, model).select("source_id", "merchant_name", "category_id", "category_tier")


def accepted_transactions(spark, sf):
    return tb.transactions(spark, sf).select(
        *CANONICAL, "external_id", "category_id", "category_tier", "created_at", "transacted_date"
    )


def categorise_seed(spark, sf):
    """Merchants of the raw records under the real category seed."""
    records = tb.unified(spark, sf).select("merchant_name", "merchant_mcc").distinct()
    return cg.categorise(records, load_categories(spark))


def category_by_code(spark, sf):
    found = pc.category_by_code(tb.part_categories(spark, sf), "promo_brand_12")
    return found.select("id", "code", "label", "path", "parent_id")


def category_paths(spark, sf):
    """Paths of a tree of four levels."""
    return cg.category_paths(tb.part_tree(spark, sf)).select("id", "code", "path", "depth")


def _event_fields(events, *names):
    fields = F.json_tuple("value", *names).alias(*names)  # the text is parsed once
    return events.select("key", fields).withColumn("amount", F.col("amount").cast("decimal(19,4)"))


def accepted_events(spark, sf):
    events = tables.accepted_events(tb.transactions(spark, sf))
    return _event_fields(events, "source_id", "account_id", "amount", "status")


def categorised_events(spark, sf):
    events = tables.categorised_events(tb.transactions(spark, sf), tb.categories(spark))
    return _event_fields(events, "source_id", "account_id", "amount", "category_code", "category_tier")


def category_orphans(spark, sf):
    """Transactions whose category is not among those with keywords."""
    known = pc.categories_with_keywords(tb.categories(spark))
    return cg.orphans(tb.transactions(spark, sf), known).select("source_id", "category_id")


# ---- rollups -------------------------------------------------------------------------------


def _rollup(spark, sf, *period_types):
    return rollup.rollup(tb.transactions(spark, sf), period_types or (DAILY, WEEKLY, MONTHLY))


def rollup_daily(spark, sf):
    return _rollup(spark, sf, DAILY).select(*ROLLUP)


def rollup_weekly(spark, sf):
    return _rollup(spark, sf, WEEKLY).select(*ROLLUP)


def rollup_monthly(spark, sf):
    return _rollup(spark, sf, MONTHLY).select(*ROLLUP)


def rollup_full(spark, sf):
    return _rollup(spark, sf).select(*ROLLUP)


def rollup_reversals(spark, sf):
    return _rollup(spark, sf).select(*ROLLUP).where("total_reversed > 0")


def rollup_incremental(spark, sf):
    """Three batches, one of them written twice, with a compaction in between."""
    store = tables.Store(spark, scratch_path(spark, "rollup"))
    store.write_transactions(tb.transactions(spark, sf, written=True), 0)
    stored = store.transactions()
    bounds = ["amount < 30000", "amount >= 30000 AND amount < 60000", "amount >= 60000"]
    for batch_id in (0, 1):
        store.write_rollup_part(rollup.daily_rollup(stored.where(bounds[batch_id])), batch_id)
    store.write_rollup_part(rollup.daily_rollup(stored.where(bounds[1])), 1)
    store.compact_rollup(up_to_batch=1)
    store.write_rollup_part(rollup.daily_rollup(stored.where(bounds[2])), 2)
    return store.rollup().select(*ROLLUP)


# ---- spend queries -------------------------------------------------------------------------


def category_summary(spark, sf):
    return spending.category_summary(
        _rollup(spark, sf, MONTHLY),
        tb.categories(spark),
        period_type=MONTHLY,
        date_from=date(1997, 1, 1),
        date_to=date(1998, 12, 31),
    )


def stored_summary(spark, sf):
    """The category summary from a stored rollup: parts of three batches, two of them folded into the base."""
    store = tables.Store(spark, scratch_path(spark, "rollup"))
    rows = tb.transactions(spark, sf)
    for batch_id, status in enumerate(("status = 'SETTLED' AND amount < 30000", "status = 'SETTLED' AND amount >= 30000", "status <> 'SETTLED'")):
        store.write_rollup_part(rollup.daily_rollup(rows.where(status)), batch_id)
    store.compact_rollup(up_to_batch=1)
    return spending.category_summary(
        store.rollup((MONTHLY,)),
        tb.categories(spark),
        period_type=MONTHLY,
        date_from=date(1997, 1, 1),
        date_to=date(1998, 12, 31),
    )


def by_category(spark, sf):
    return spending.by_category(_rollup(spark, sf, DAILY), tb.categories(spark))


def time_series(spark, sf):
    return spending.time_series(_rollup(spark, sf, WEEKLY), period_type=WEEKLY)


def account_time_series(spark, sf):
    return spending.time_series(
        _rollup(spark, sf, MONTHLY), account_id="0042", period_type=MONTHLY, date_from=date(1996, 1, 1)
    )


def top_merchants(spark, sf):
    return pt.top_merchants(tb.transactions(spark, sf), limit=10, status="SETTLED")


def merchant_totals(spark, sf):
    return pt.merchant_totals(tb.transactions(spark, sf), require_mcc=False)


# ---- transaction queries -------------------------------------------------------------------


def top_transactions(spark, sf):
    return pt.top_transactions(
        tb.transactions(spark, sf),
        limit=25,
        status="SETTLED",
        date_from=date(1997, 1, 1),
        date_to=date(1998, 12, 31),
        time_col="transacted_at",
    ).select(*CANONICAL)


def _listing(spark, sf):
    return pt.list_transactions(
        tb.transactions(spark, sf),
        tb.categories(spark),
        account_id="cus_8",
        date_from=date(2024, 1, 3),
        date_to=date(2024, 1, 28),
        page=1,
    )


def list_transactions(spark, sf):
    return _listing(spark, sf).data


def list_transactions_meta(spark, sf):
    return _listing(spark, sf).meta


def _search(spark, sf):
    return pt.merchant_search(
        tb.transactions(spark, sf),
        tb.categories(spark),
        "RING",
        page=2,
        page_size=50,
        order="merchantName",
        direction="asc",
    )


def merchant_search(spark, sf):
    return _search(spark, sf).data


def merchant_search_meta(spark, sf):
    return _search(spark, sf).meta


def deep_page(spark, sf):
    keys = [paging.SortKey("amount"), paging.SortKey("source_id")]
    return paging.take_page(tb.transactions(spark, sf).select(*CANONICAL), keys, 100, 100)


def list_transactions_after(spark, sf):
    """The page after a given row."""
    return pt.list_transactions_after(
        tb.transactions(spark, sf),
        tb.categories(spark),
        after=(Decimal("20000.0000"), "CN-1-1"),
        page_size=50,
        order="amount",
    )


def _stored(spark, sf):
    """All transactions in a store, compacted by day with Bloom filters on the ids."""
    store = tables.Store(spark, scratch_path(spark, "stored"))
    store.write_transactions(tb.transactions(spark, sf, written=True), 0)
    store.compact_transactions(up_to_batch=0)
    return store.transactions()


def stored_listing(spark, sf):
    """The listing of one account, on the stored table; the days are folders."""
    return pt.list_transactions(
        _stored(spark, sf),
        tb.categories(spark),
        account_id="cus_8",
        date_from=date(2024, 1, 3),
        date_to=date(2024, 1, 28),
        time_col="transacted_at",
        page_size=30,
    ).data


def stored_search(spark, sf):
    """The merchant search on a store, by the trigrams of its merchant names."""
    store = tables.Store(spark, scratch_path(spark, "search"))
    stored = store.put_transactions(tb.transactions(spark, sf, written=True), 0)
    store.manifest.commit([stored, store.put_merchants(store.read([stored], "transactions"), 0)])
    return pt.merchant_search(
        store.transactions(),
        tb.categories(spark),
        "RING",
        page=2,
        page_size=50,
        order="merchantName",
        direction="asc",
        names=store.merchants_with("RING"),
    ).data


def stored_by_id(spark, sf):
    return pt.transaction_by_id(
        _stored(spark, sf), tb.categories(spark), "30b80e7d-e46c-8d83-f242-e603b1affd7e"
    )


def transaction_by_id(spark, sf):
    rows = tb.transactions(spark, sf)
    return pt.transaction_by_id(rows, tb.categories(spark), "30b80e7d-e46c-8d83-f242-e603b1affd7e")


# ---- comparison ----------------------------------------------------------------------------


def _category_sums(spark, sf, per=()):
    return compare.category_sums(_rollup(spark, sf, DAILY), tb.categories(spark), YEAR_1998, per)


def compare_periods(spark, sf):
    return compare.period_summaries(compare.report_totals(_category_sums(spark, sf)), YEAR_1998)


def compare_delta(spark, sf):
    return compare.spend_delta(compare.report_totals(_category_sums(spark, sf)))


def compare_by_category(spark, sf):
    return compare.by_spend(compare.category_breakdown(_category_sums(spark, sf), tb.categories(spark)))


def compare_by_account(spark, sf):
    """One report per account, for all accounts in one job."""
    per = ["account_id"]
    return compare.category_breakdown(_category_sums(spark, sf, per), tb.categories(spark), per)


def compare_series(spark, sf):
    return compare.compare_series(_rollup(spark, sf, MONTHLY), tb.categories(spark), YEAR_1998_BY_MONTH)


def compare_report(spark, sf):
    """The whole report of a year by months, from one reading of the rollup; its lists as text."""
    report = compare.compare_report(_rollup(spark, sf, MONTHLY), tb.categories(spark), YEAR_1998_BY_MONTH)
    text = lambda rows, *names: F.transform(rows, lambda r: F.concat_ws(":", *[r[n].cast("string") for n in names]))
    breakdown = ("category_code", "current_spend", "previous_spend", "delta_pct", "share_of_total_current")
    return report.select(
        *[
            F.col(f"{period}.{field}").alias(f"{period}_{name}")
            for period in ("current", "previous")
            for field, name in (("total_spend", "spend"), ("transaction_count", "count"))
        ],
        "delta.spend_percentage",
        "delta.direction",
        F.array_join(text("by_category", *breakdown), ",").alias("by_category"),
        F.array_join(text("time_series", "period_date", "current_spend", "previous_spend"), ",").alias("time_series"),
        F.array_join(F.array_sort(text("anomalies", "category_code", "reason")), ",").alias("anomalies"),
    )


def anomalies(spark, sf):
    return compare.detect_anomalies(compare_by_account(spark, sf), ["account_id"])


# ---- category dimension --------------------------------------------------------------------


def list_categories(spark, sf):
    return pc.list_categories(tb.part_categories(spark, sf), page=2).data


def list_categories_meta(spark, sf):
    return pc.list_categories(tb.part_categories(spark, sf), page=2).meta


def category_by_id(spark, sf):
    dimension = tb.part_categories(spark, sf)
    return pc.category_by_id(dimension, "cb6dea2c-a759-9c58-1715-40abfa6b6ec6")


def category_by_mcc(spark, sf):
    return pc.categories_by_mcc(tb.part_categories(spark, sf), "5007, 5011", page_size=1000).data


def category_tree(spark, sf):
    return cg.with_parent(tb.part_categories(spark, sf)).select(
        "code", "path", "depth", "parent_code", "parent_label"
    )


def root_categories(spark, sf):
    return pc.root_categories(tb.part_categories(spark, sf)).select("id", "code", "label")


# ---- streams -------------------------------------------------------------------------------


def _land_by_step(folders):
    """Records (by folder) as they are, in a folder for each of two steps, side by side. A task keeps both files open and sorts
    nothing."""
    spark = next(iter(folders.values())).sparkSession
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        writers = {path: records.write.options(**tables.COMPACT).partitionBy("step") for path, records in folders.items()}
        ingest.together(*[partial(writer.parquet, path) for path, writer in writers.items()])


def _streams(spark, sf, run):
    """Land the records of all sources in two steps, the cheaper copies first, and run the
    streaming job (``run(streams)`` starts it) after each step on the same checkpoint."""
    folder = scratch_path(spark, "raw")
    raw = tb.raw_sources(spark, sf)
    step = F.when(F.col("amount") < 50000, 0).otherwise(1)
    _land_by_step({f"{folder}/{source}": records.withColumn("step", step) for source, records in raw.items()})
    for steps in ("step=0", "step=*"):  # the second step finds the files of the first as well
        run(
            {
                source: stream_records(spark, source, f"{folder}/{source}/{steps}", "parquet", records.schema)
                for source, records in raw.items()
            }
        ).awaitTermination()


def _ingested(spark, sf, **options):
    store = tables.Store(spark, scratch_path(spark, "store"))
    checkpoint = scratch_path(spark, "checkpoint")
    _streams(
        spark,
        sf,
        lambda raw: ingest.start_ingest(raw, store, tb.categories(spark), checkpoint, **{"max_age_days": None, **options}),
    )
    return store


def stream_dedup(spark, sf):
    """First arrivals of all sources, as the ingest job stores them."""
    return _ingested(spark, sf).transactions().select(*CANONICAL)


def _accepted(spark, sf):
    store, checkpoint = tables.Store(spark, scratch_path(spark, "accepted")), scratch_path(spark, "checkpoint")
    _streams(spark, sf, lambda raw: accepted.start_accepted(raw, store, checkpoint, max_age_days=None))
    return store.accepted()


def stream_dedup_ttl(spark, sf):
    """Accepted stream with the default time to live; records of any age arrive, none is late."""
    return _accepted(spark, sf).select("source_id", "account_id")


def stream_accepted(spark, sf):
    """The same with all fields of the first arrivals."""
    return _accepted(spark, sf).select(*CANONICAL)


def stream_dedup_forgets(spark, sf):
    """All records three times, the last after their time to live: the accepted stream forgot them and accepts them again,
    the stored ids make them duplicates."""
    folder, raw = scratch_path(spark, "raw"), tb.raw_sources(spark, sf)
    recent, store = (tables.Store(spark, scratch_path(spark, name)) for name in ("recent", "store"))
    checkpoint, dimension, before = scratch_path(spark, "checkpoint"), tb.categories(spark), {}

    def stored(rows, batch_id):
        ingest.process_batch(rows, batch_id, store, dimension, max_age_days=None)

    for hours in (0, 23, 25):
        streams = {}
        for source, records in raw.items():
            landed = f"{folder}/{source}/after{hours}"
            if hours:  # what was sent first is sent again: files of a new name are new to the stream
                renamed(spark, before[source], landed)
            else:
                records.write.options(**tables.COMPACT).parquet(landed)
            before[source] = landed
            stream = stream_records(spark, source, f"{folder}/{source}/*", "parquet", records.schema)
            streams[source] = stream.withColumn("seen_at", F.lit(tb.PAYMENTS_AS_OF + timedelta(hours=hours)))
        accepted.start_accepted(streams, recent, checkpoint, sink=stored, max_age_days=None).awaitTermination()
    return store.outcomes().where("records > 0").select("batch_id", "source_type", "outcome", "records")


def _payment_lifecycles(spark, sf):
    """Payment events of which three share a payment, sent again in part, in two batches."""
    folder, store = scratch_path(spark, "payments"), tables.Store(spark, scratch_path(spark, "store"))
    checkpoint, events = scratch_path(spark, "checkpoint"), tb.payment_lifecycles(spark, sf)
    _land_by_step({folder: events})  # both steps by one reading of the events
    schema = events.drop("step").schema
    for steps in ("step=0", "step=*"):  # the second step finds the files of the first as well
        stream = {PAYMENT_PROCESSOR: stream_records(spark, PAYMENT_PROCESSOR, f"{folder}/{steps}", "parquet", schema)}
        job = ingest.start_ingest(stream, store, tb.categories(spark), checkpoint, max_age_days=None)
        job.awaitTermination()
    return store


def stream_payment_repeats(spark, sf):
    """What is stored of payments with several events, some of them sent again under another payment id."""
    return _payment_lifecycles(spark, sf).transactions().select(*CANONICAL)


def stream_payment_outcomes(spark, sf):
    """The same: outcomes of all events, the ones sent again by themselves."""
    return reports.ingest_report(_payment_lifecycles(spark, sf).outcomes())


def _frail_model(requests):
    """The widget model, which breaks on dear widgets."""
    dear = requests["merchant_name"].str.contains("widget") & (requests["amount"].astype("float64") > 90000)
    if dear.any():
        raise ValueError("too dear")
    return _widget_model(requests)


def dead_letter_stages(spark, sf):
    """Rows that break at each stage, in one batch with sound ones: no fallback category, a model that fails on some
    rows, times before the year 1 and events too large for a message."""
    store = tables.Store(spark, scratch_path(spark, "store"))
    ending = F.substring("source_id", -2, 2)
    rows = tb.unified(spark, sf).withColumns(
        {
            "merchant_name": F.when(ending == "37", F.lit("x" * 5000)).otherwise(F.col("merchant_name")),
            "transacted_at": F.when(ending == "41", F.lit("0000-06-01").cast("timestamp")).otherwise(F.col("transacted_at")),
        }
    )
    dimension = tb.categories(spark).where("code <> 'uncategorised'")
    model = classify.python_classifier(_frail_model)
    ingest.process_batch(rows, 0, store, dimension, model, max_age_days=None, max_event_bytes=4000)
    return store.dead_letters().select("source_id", "stage", "reject_reason")


def stream_transactions(spark, sf):
    return _ingested(spark, sf).transactions().select("source_id", "amount", "category_id", "category_tier")


def stream_outcomes(spark, sf):
    return reports.ingest_report(_ingested(spark, sf).outcomes())


def stream_counters(spark, sf):
    """The counters of the running job, as successes and failures."""
    live = Counters()
    _ingested(spark, sf, counters=live)
    return reports.processing_counters(live.frame(spark))


def stream_age_guard(spark, sf):
    """The ingest with the age rules on, at one moment: outcomes per source."""
    as_of = f"CASE WHEN source_type = '{PAYMENT_PROCESSOR}' THEN TIMESTAMP '{tb.PAYMENTS_AS_OF}' ELSE ingested_at END"
    return reports.ingest_report(_ingested(spark, sf, as_of=as_of, max_age_days=7).outcomes())


def stream_rollup_monthly(spark, sf):
    return _ingested(spark, sf).rollup((MONTHLY,)).select(*ROLLUP)


def topic_round_trip(spark, sf):
    """Accepted events read back from a topic."""
    return parse_events(tables.accepted_events(tb.transactions(spark, sf))).select(*CANONICAL)


def _judged_events(spark, sf):
    """All accepted events, those whose id ends in 7 with an amount that is no number, read from the topic and
    judged together, so that what a broken event does to sound ones shows."""
    events = tables.accepted_events(tb.transactions(spark, sf))
    spoilt = F.regexp_replace("value", '"amount":[0-9.]+', '"amount":"oops"')
    events = events.withColumn("value", F.when(F.expr("endswith(key, '7')"), spoilt).otherwise(F.col("value")))
    return parse_events(events), validate.ingest_rules(max_age_days=None)


def _keeps_text(payload):
    return F.coalesce(F.contains(payload, F.lit("oops")), F.lit(False)).alias("keeps_text")


def topic_bad_field(spark, sf):
    """Events with an amount that is no number: rejected, and the dead letter keeps the event's text."""
    letters = tables.to_dead_letters(validate.rejected_rows(*_judged_events(spark, sf)))
    return letters.select("source_id", "reject_reason", _keeps_text(F.col("raw_payload")))


def topic_outcomes(spark, sf):
    """The same events, sound and broken, each with its fields and its reason for rejection."""
    judged = validate.with_reject_reasons(*_judged_events(spark, sf))
    return judged.select(*CANONICAL, "reject_reason", _keeps_text(F.col("raw_payload")))


def windowed_rollup(spark, sf):
    """Weekly rollup as a streaming aggregation over the stored transactions. Batches follow each other, so their number
    is bounded: a batch takes two files, or more once there are many."""
    folder, out = scratch_path(spark, "facts"), scratch_path(spark, "weekly")
    facts = tb.transactions(spark, sf).select("account_id", "category_id", "status", "amount", "transacted_at")
    facts.write.parquet(folder)
    files = sum(name.endswith(".parquet") for name in names_in(spark, folder))
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", max(2, -(-files // MOST_BATCHES))).parquet(folder)
    checkpoint = scratch_path(spark, "checkpoint")
    stream_rollup.start_windowed_rollup(stream, WEEKLY, out, checkpoint).awaitTermination()
    return stream_rollup.windowed_rollup(spark.read.parquet(out)).select(*ROLLUP)


_QUERIES: dict[str, Query] = {
    function.__name__: function
    for function in (
        normalise_card,
        normalise_bank,
        normalise_payment,
        unified_transactions,
        payload_field_query,
        stored_payload_query,
        validation_rejects,
        large_reversals,
        ingest_outcomes,
        ingest_report,
        processing_counters,
        dedup_first_wins,
        source_repeats,
        drop_stored,
        dead_letter_report,
        dead_letter_context,
        validation_all_rules,
        registered_source_ingest,
        topic_round_trip,
        topic_bad_field,
        topic_outcomes,
        categorise_seed,
        category_by_code,
        category_paths,
        categorise_mcc,
        categorise_keyword,
        categorise_tiers,
        python_classifier,
        ml_fallback,
        accepted_transactions,
        accepted_events,
        categorised_events,
        category_orphans,
        rollup_daily,
        rollup_weekly,
        rollup_monthly,
        rollup_full,
        rollup_reversals,
        rollup_incremental,
        category_summary,
        stored_summary,
        by_category,
        time_series,
        account_time_series,
        top_merchants,
        merchant_totals,
        top_transactions,
        list_transactions,
        list_transactions_meta,
        merchant_search,
        merchant_search_meta,
        deep_page,
        list_transactions_after,
        stored_listing,
        stored_search,
        stored_by_id,
        transaction_by_id,
        compare_periods,
        compare_delta,
        compare_by_category,
        compare_by_account,
        compare_series,
        compare_report,
        anomalies,
        list_categories,
        list_categories_meta,
        category_by_id,
        category_by_mcc,
        category_tree,
        root_categories,
        stream_dedup,
        stream_dedup_ttl,
        stream_accepted,
        stream_dedup_forgets,
        stream_payment_repeats,
        stream_payment_outcomes,
        dead_letter_stages,
        stream_transactions,
        stream_outcomes,
        stream_counters,
        stream_age_guard,
        windowed_rollup,
    )
}
_QUERIES["stream_rollup"] = stream_rollup_monthly


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """The text corpus queries and their SQL; none where that subpackage is not installed."""
    here = os.path.dirname(os.path.abspath(__file__))
    installed = all(os.path.exists(os.path.join(here, f)) for f in ("centsible/llm/queries.py", "corpus_pipeline.py"))
    try:
        import corpus_pipeline
        from centsible.llm import queries as corpus_queries
    except ImportError:
        if installed:
            raise
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**corpus_queries.QUERIES, "pipeline": corpus_pipeline.run}, {**corpus_queries.SQL, **sql}


def _registered(query: Query, ingest: bool = True) -> Query:
    return lambda spark, sf_dir: present(query(prepare(spark, ingest), sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Spend by category of the whole ingest path at the smallest scale."""
    return _registered(by_category)(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    corpus = {name: _registered(query, ingest=False) for name, query in _corpus()[0].items()}
    return {name: _registered(query) for name, query in _QUERIES.items()} | corpus


def oracle_sql() -> dict[str, str]:
    return {**oracle.oracle_sql(), **_corpus()[1]}
