"""Schemas and fixed values of the transaction data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 4)
TOTAL = T.DecimalType(38, 4)  # sums over many accounts outgrow MONEY

# Fixed values.
BANK_FEED = "BANK_FEED"
PAYMENT_PROCESSOR = "PAYMENT_PROCESSOR"
CARD_NETWORK = "CARD_NETWORK"
SOURCE_TYPES = (BANK_FEED, PAYMENT_PROCESSOR, CARD_NETWORK)

PENDING = "PENDING"
SETTLED = "SETTLED"
REVERSED = "REVERSED"
STATUSES = (PENDING, SETTLED, REVERSED)

# ISO 4217 codes of currencies and funds in use.
CURRENCIES = tuple(
    """
    AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD
    CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP
    GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW
    KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN
    NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD
    SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW
    UZS VED VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG
    """.split()
)

DAILY = "DAILY"
WEEKLY = "WEEKLY"
MONTHLY = "MONTHLY"
PERIOD_TYPES = (DAILY, WEEKLY, MONTHLY)

ACCEPTED = "ACCEPTED"
DUPLICATE = "DUPLICATE"
FAILED = "FAILED"
OUTCOMES = (ACCEPTED, DUPLICATE, FAILED)
#: Not an outcome of ingest: the source sent the same raw record again.
REPEATED = "REPEATED"

FALLBACK_CATEGORY = "uncategorised"


STRING = T.StringType()
LONG = T.LongType()
INT = T.IntegerType()
DATE = T.DateType()
TIMESTAMP = T.TimestampType()
STRINGS = T.ArrayType(STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Raw source records.
BANK_SCHEMA = _struct(
    transaction_id=STRING,
    account_id=STRING,
    merchant_name=STRING,
    amount=MONEY,
    currency=STRING,
    transacted_at=TIMESTAMP,
    status=STRING,
)
PAYMENT_SCHEMA = _struct(
    event_id=STRING,
    event_type=STRING,
    payment_id=STRING,
    customer_id=STRING,
    merchant_descriptor=STRING,
    amount=MONEY,
    currency=STRING,
    created_at=TIMESTAMP,
    retry_attempt=INT,
)
CARD_SCHEMA = _struct(
    record_id=STRING,
    auth_code=STRING,
    pan_last_four=STRING,
    merchant_name=STRING,
    merchant_city=STRING,
    mcc=STRING,
    amount=MONEY,
    currency=STRING,
    authorised_at=TIMESTAMP,
    cleared_at=TIMESTAMP,
    clearing_status=STRING,
)
SOURCE_SCHEMAS = {
    BANK_FEED: BANK_SCHEMA,
    PAYMENT_PROCESSOR: PAYMENT_SCHEMA,
    CARD_NETWORK: CARD_SCHEMA,
}

# The canonical event all sources are mapped to.
NORMALISED_SCHEMA = _struct(
    source_id=STRING,
    source_type=STRING,
    account_id=STRING,
    amount=MONEY,
    currency=STRING,
    merchant_name=STRING,
    merchant_mcc=STRING,
    transacted_at=TIMESTAMP,
    status=STRING,
    raw_payload=STRING,
)

# Stored tables.
CATEGORY_SCHEMA = _struct(
    id=LONG,
    external_id=STRING,
    code=STRING,
    label=STRING,
    path=STRING,
    parent_id=LONG,
    mcc_codes=STRINGS,
    keywords=STRINGS,
)
TRANSACTION_SCHEMA = _struct(
    source_id=STRING,
    source_type=STRING,
    account_id=STRING,
    amount=MONEY,
    currency=STRING,
    merchant_name=STRING,
    merchant_mcc=STRING,
    transacted_at=TIMESTAMP,
    status=STRING,
    raw_payload=STRING,
    external_id=STRING,
    category_id=LONG,
    category_tier=STRING,
    created_at=TIMESTAMP,
    updated_at=TIMESTAMP,
    batch_id=LONG,
    transacted_date=DATE,
)
ROLLUP_KEYS = ["account_id", "category_id", "period_date", "period_type"]
ROLLUP_SCHEMA = _struct(
    account_id=STRING,
    category_id=LONG,
    period_date=DATE,
    total_spend=MONEY,
    transaction_count=LONG,
    total_reversed=MONEY,
    updated_at=TIMESTAMP,
    period_type=STRING,
)
# One micro-batch's share of the daily rollup.
ROLLUP_PART_SCHEMA = _struct(
    account_id=STRING,
    category_id=LONG,
    period_date=DATE,
    total_spend=MONEY,
    transaction_count=LONG,
    total_reversed=MONEY,
    updated_at=TIMESTAMP,
    batch_id=LONG,
)
DEAD_LETTER_SCHEMA = _struct(
    source_id=STRING,
    source_type=STRING,
    account_id=STRING,
    amount=MONEY,
    currency=STRING,
    merchant_name=STRING,
    merchant_mcc=STRING,
    transacted_at=TIMESTAMP,
    status=STRING,
    raw_payload=STRING,
    ingested_at=TIMESTAMP,
    origin=STRING,
    stage=STRING,
    reject_reason=STRING,
    reject_reasons=STRINGS,
    batch_id=LONG,
)
OUTCOME_SCHEMA = _struct(
    source_type=STRING,
    outcome=STRING,
    records=LONG,
    batch_id=LONG,
)
EVENT_SCHEMA = _struct(
    key=STRING,
    value=STRING,
    batch_id=LONG,
)
# What the accepted stream keeps of each first arrival.
ACCEPTED_SCHEMA = T.StructType([*NORMALISED_SCHEMA.fields, T.StructField("ingested_at", TIMESTAMP), T.StructField("batch_id", LONG)])

# The source records as parsed values, written once per transaction.
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("source_id", STRING),
        T.StructField("source_type", STRING),
        T.StructField("payload", T.VariantType()),
        T.StructField("batch_id", LONG),
    ]
)

# Trigrams of the distinct merchant names of each batch; every name once more under the empty text.
MERCHANT_GRAM_SCHEMA = _struct(gram=STRING, merchant_name=STRING, batch_id=LONG)
