"""The given star-schema tables seen as the three raw sources.

Card records come from line items, bank records from orders and payment events from events.
A line item's order key and line number repeat with other contents, which gives natural
duplicates; the arrival order of the copies is the order of (price, part, supplier, ship date).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centsible.functions.status import translate
from centsible.functions.text import stable_id
from centsible.plans.ingest import ingest, normalised
from centsible.schemas import BANK_FEED, CARD_NETWORK, PAYMENT_PROCESSOR
from centsible.sources.categories import load_categories

# Fixed values of the mapping.
CURRENCIES = ["ZAR", "USD", "GBP", "EUR"]
PART_TYPE_MCC = {
    "STANDARD": "5072",
    "MEDIUM": "5251",
    "PROMO": "5311",
    "LARGE": "5399",
    "ECONOMY": "5411",
    "SMALL": "5999",
}
CLEARING_STATUS = {"N": "CLEARED", "A": "AUTH", "R": "REVERSED"}
BANK_STATUS = {"F": "SETTLED", "O": "PENDING", "P": "REVERSED"}
PAYMENT_EVENT_TYPE = {
    "purchase": "payment_intent.succeeded",
    "click": "payment_intent.created",
    "error": "charge.refunded",
}
# id, code, label, parent id, MCC list, keyword list
CATEGORIES = [
    (1, "hardware", "Hardware", None, None, None),
    (2, "anvils", "Anvils", 1, "5072", "anvil"),
    (3, "bolts", "Bolts & Nuts", 1, None, "bolt,nut"),
    (4, "gears", "Gears", 1, None, "gear"),
    (5, "gizmos", "Gizmos", 1, "5251,5065", "gizmo"),
    (6, "plates", "Plates", 1, None, "plate"),
    (7, "rings", "Rings", 1, None, "ring"),
    (8, "rods", "Rods", 1, None, "rod"),
    (9, "uncategorised", "Uncategorised", None, None, None),
]
# The age rules are tried on the payments of this moment; older tables have no age limit.
PAYMENTS_AS_OF = datetime(2024, 1, 25)


# The columns used of each table; with a schema given, no footer has to be read to plan.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_mktsegment string, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A given table, dealt out by ``spread_by``: the key of the join that follows."""
    df = spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spread_by) if spread_by else df


def categories(spark: SparkSession) -> DataFrame:
    return load_categories(spark, CATEGORIES)


def _currency(number: str) -> str:
    codes = ", ".join(f"'{code}'" for code in CURRENCIES)
    return f"element_at(array({codes}), CAST({number} % 4 + 1 AS INT))"


def _arrival(at: str, price: str, first: str, second: str, day: str) -> list[str]:
    """Records arrive an hour after they happen; copies arrive in the given order."""
    return [
        f"{at} + INTERVAL 1 HOUR AS ingested_at",
        f"""named_struct('price', {price}, 'first', CAST({first} AS BIGINT),
            'second', CAST({second} AS BIGINT), 'day', {day}) AS arrival_seq""",
    ]


def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    lines = (
        table(spark, sf_dir, "lineitem", "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    authorised = "CAST(o_orderdate AS TIMESTAMP)"
    cleared = "CASE WHEN l_returnflag <> 'A' THEN CAST(l_shipdate AS TIMESTAMP) END"
    return lines.selectExpr(
        "concat_ws('-', 'CN', l_orderkey, l_linenumber) AS record_id",
        "concat('AUTH', l_suppkey) AS auth_code",
        "lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS pan_last_four",
        "p_name AS merchant_name",
        "p_brand AS merchant_city",
        f"{translate('p_type', PART_TYPE_MCC)} AS mcc",
        "CAST(l_extendedprice AS DECIMAL(19,4)) AS amount",
        f"{_currency('o_custkey')} AS currency",
        f"{authorised} AS authorised_at",
        f"{cleared} AS cleared_at",
        f"{translate('l_returnflag', CLEARING_STATUS)} AS clearing_status",
        *_arrival(
            f"coalesce({cleared}, {authorised})", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate"
        ),
    )


def bank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, sf_dir, "orders", "o_custkey").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    at = "CAST(o_orderdate AS TIMESTAMP)"
    return orders.selectExpr(
        "concat('BF-', o_orderkey) AS transaction_id",
        "concat('ACC-', lpad(CAST(o_custkey AS STRING), 4, '0')) AS account_id",
        "c_mktsegment AS merchant_name",
        "CAST(o_totalprice AS DECIMAL(19,4)) AS amount",
        f"{_currency('c_nationkey')} AS currency",
        f"{at} AS transacted_at",
        f"{translate('o_orderstatus', BANK_STATUS)} AS status",
        *_arrival(at, "o_totalprice", "o_custkey", "0", "o_orderdate"),
    )


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "CAST(ts AS TIMESTAMP)"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('evt_', event_id) AS event_id",
        f"{translate('event_type', PAYMENT_EVENT_TYPE, 'event_type')} AS event_type",
        "concat('pi_', event_id) AS payment_id",
        "concat('cus_', user_id) AS customer_id",
        "event_type AS merchant_descriptor",
        "CAST(value AS DECIMAL(19,4)) AS amount",
        f"{_currency('user_id')} AS currency",
        f"{at} AS created_at",
        "0 AS retry_attempt",
        *_arrival(at, "value", "user_id", "0", "ts"),
    )


def payment_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment events in two steps (``step``): three events share a payment, and some are sent again under another payment
    id, with the first of their kind (every seventh) or a step later (every fifth of the first step)."""
    number = "CAST(substring(event_id, 5) AS BIGINT)"
    events = payment_events(spark, sf_dir).selectExpr("*", f"{number} AS number", f"CAST({number} % 2 AS INT) AS step")
    first = events.withColumn("payment_id", F.expr("concat('pi_', number DIV 3)"))
    again = events.withColumns(
        {
            "payment_id": F.expr("concat('pi_again_', number)"),
            "retry_attempt": F.lit(1),
            "arrival_seq": F.col("arrival_seq").withField("second", F.lit(1).cast("bigint")),
        }
    )
    later = again.where("number % 5 = 0 AND step = 0").withColumn("step", F.lit(1))
    return first.unionByName(again.where("number % 7 = 0")).unionByName(later).drop("number")


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        CARD_NETWORK: card_records(spark, sf_dir),
        BANK_FEED: bank_records(spark, sf_dir),
        PAYMENT_PROCESSOR: payment_events(spark, sf_dir),
    }


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three sources as canonical rows."""
    return normalised(raw_sources(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str, classifier=None, written: bool = False) -> DataFrame:
    """The transactions table that results from all three sources; ``written``: see ``ingest``."""
    return ingest(
        raw_sources(spark, sf_dir), categories(spark), classifier=classifier, written=written, max_age_days=None
    )


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category tree taken from the part table: part types are the roots, the brands of a
    type its children; a child lists the codes of the part sizes it comes in."""
    numbers = {name: str(i) for i, name in enumerate(PART_TYPE_MCC, start=1)}
    parts = table(spark, sf_dir, "part").selectExpr(
        f"CAST({translate('p_type', numbers)} AS BIGINT) * 1000 AS type_id",
        "lower(p_type) AS type",
        "p_type AS type_label",
        "concat_ws('_', lower(p_type), lower(replace(p_brand, '#', '_'))) AS code",
        "p_brand AS brand_label",
        "CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand_number",
        "concat('50', lpad(CAST(p_size AS STRING), 2, '0')) AS mcc",
    )
    no_list = F.lit(None).cast("array<string>")
    roots = parts.select("type_id", "type", "type_label").distinct()
    children = parts.groupBy("type_id", "type", "code", "brand_label", "brand_number").agg(
        F.sort_array(F.collect_set("mcc")).alias("mcc_codes")
    )
    return roots.select(
        F.col("type_id").alias("id"),
        stable_id(F.col("type")).alias("external_id"),
        F.col("type").alias("code"),
        F.col("type_label").alias("label"),
        F.col("type").alias("path"),
        F.lit(None).cast("bigint").alias("parent_id"),
        no_list.alias("mcc_codes"),
        no_list.alias("keywords"),
    ).unionByName(
        children.select(
            (F.col("type_id") + F.col("brand_number")).alias("id"),
            stable_id(F.col("code")).alias("external_id"),
            "code",
            F.col("brand_label").alias("label"),
            F.concat_ws(".", "type", "code").alias("path"),
            F.col("type_id").alias("parent_id"),
            "mcc_codes",
            no_list.alias("keywords"),
        )
    )


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of four levels taken from the part table, without paths: type, brand, tens of the size, size."""
    numbers = {name: str(i) for i, name in enumerate(PART_TYPE_MCC, start=1)}
    parts = table(spark, sf_dir, "part").selectExpr(
        f"CAST({translate('p_type', numbers)} AS BIGINT) * 1000000 AS type_id",
        "lower(p_type) AS type",
        "CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand",
        "CAST(p_size AS BIGINT) AS size",
    )
    levels = F.expr(
        """array(
        named_struct('id', type_id, 'code', type, 'parent_id', CAST(NULL AS BIGINT)),
        named_struct('id', type_id + brand * 10000, 'code', concat('b', brand), 'parent_id', type_id),
        named_struct('id', type_id + brand * 10000 + (size DIV 10 + 1) * 100, 'code', concat('t', size DIV 10),
            'parent_id', type_id + brand * 10000),
        named_struct('id', type_id + brand * 10000 + (size DIV 10 + 1) * 100 + size % 10 + 1, 'code', concat('s', size),
            'parent_id', type_id + brand * 10000 + (size DIV 10 + 1) * 100))"""
    )
    return parts.select(F.inline(levels)).distinct()
