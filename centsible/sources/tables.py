"""Stored tables: Parquet folders written once, named by a manifest.

A batch writes its rows of every table into folders of their own and commits them together; a batch that is
run again replaces what it committed before. Parts are merged level by level, so their number grows with the logarithm
of the batches, and old versions are removed. See ``manifest.py`` and, for the keys, ``keys.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible import schemas as S
from centsible.functions.text import stable_id
from centsible.operators.categorise import with_category
from centsible.operators.rollup import expand_periods, merge_daily, merge_rollups
from centsible.operators.stages import EVENT_FORMAT, event_value
from centsible.operators.trigrams import names_with, postings
from centsible.session import COMPACT
from centsible.sources import keys as K
from centsible.sources.manifest import Manifest, Part, names_in, size_of

ID_BLOOM_FILTERS = {
    **COMPACT,
    "parquet.bloom.filter.enabled#external_id": "true",
    "parquet.bloom.filter.enabled#source_id": "true",
    "parquet.bloom.filter.enabled#merchant_name": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
SCHEMAS = {
    "transactions": S.TRANSACTION_SCHEMA,
    "dead_letters": S.DEAD_LETTER_SCHEMA,
    "outcomes": S.OUTCOME_SCHEMA,
    "categorised_events": S.EVENT_SCHEMA,
    "rollup_parts": S.ROLLUP_PART_SCHEMA,
    "rollup_base": S.ROLLUP_SCHEMA,
    "accepted": S.ACCEPTED_SCHEMA,
    "payloads": S.PAYLOAD_SCHEMA,
    "merchant_grams": S.MERCHANT_GRAM_SCHEMA,
}
#: Key indexes: stored ids, record keys of stored batches, and both of the accepted stream, by hour.
IDS, RECORD_KEYS, RECENT_IDS, RECENT_RECORDS = "ids", "record_keys", "recent_ids", "recent_records"
BY_DAY = "day"
#: What the dead letters need of a row that broke at a later stage, beside the columns of a transaction.
BROKEN_CONTEXT = ("ingested_at", "arrival_seq", "failed_stage", "reject_reason", "reject_reasons")


def read_parts(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Exactly these folders: a missing one fails."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Store:
    """The tables of one deployment, below one root folder of shared storage.

    ``fan`` parts of a level are merged into one of the next. A merged part of the transactions gets a folder per
    day if a day fills ``day_bytes`` on average; smaller ones are sorted by day, so their row groups can be skipped.
    """

    spark: SparkSession
    root: str
    fan: int = 8
    keep: int = 16
    day_bytes: int = 64 << 20

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, self.root, self.keep)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def parts(self, *tables: str) -> list[Part]:
        return [part for part in self.manifest.newest()[1] if part.table in tables]

    def _new(self, table: str, level: int, first: int, last: int, key: str | None = None) -> Part:
        return Part(table, f"{table}/level{level}-{first}-{last}-{uuid.uuid4().hex[:12]}", level, first, last, key)

    def read(self, parts: Iterable[Part], table: str) -> DataFrame:
        schema, parts = SCHEMAS[table], list(parts)
        flat = read_parts(self.spark, [self.path(p.path) for p in parts if p.key != BY_DAY], schema)
        # folders by day are partitions below a root of their own, so such parts are read one by one
        days = [read_parts(self.spark, [self.path(p.path)], schema).select(*schema.names) for p in parts if p.key == BY_DAY]
        return reduce(DataFrame.unionByName, days, flat)

    def table(self, table: str) -> DataFrame:
        return self.read(self.parts(table), table)

    def put(self, table: str, rows: DataFrame, batch_id: int, key: str | None = None) -> Part:
        """The rows of a batch as a part that is not committed yet."""
        part = self._new(table, 0, batch_id, batch_id, key)
        rows.select(*SCHEMAS[table].names).write.options(**COMPACT).parquet(self.path(part.path))
        return part

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """The same, committed."""
        self.manifest.commit([self.put(table, rows, batch_id)])

    # merging

    def _due(self, tables: tuple[str, ...], below: int) -> list[Part]:
        """Parts of a table and level that are enough to be merged; none of a batch that may be run again."""
        groups: dict[tuple, list[Part]] = {}
        for part in sorted(self.parts(*tables), key=lambda p: (p.first, p.path)):
            if part.last < below:
                shared = None if part.key == BY_DAY else part.key
                groups.setdefault((part.table, shared, part.level), []).append(part)
        return next((group[: self.fan] for group in groups.values() if len(group) >= self.fan), [])

    def merge(self, below: int, *tables: str) -> None:
        """Merge parts of batches before ``below`` until no table has ``fan`` of a level."""
        while due := self._due(tables, below):
            self.manifest.commit([self._merged(due)], drop=due)

    def _merged(self, parts: list[Part]) -> Part:
        table, level = parts[0].table, max(p.level for p in parts)
        key = None if parts[0].key == BY_DAY else parts[0].key
        part = self._new(table, level + 1, min(p.first for p in parts), max(p.last for p in parts), key)
        if table not in SCHEMAS:
            K.merge_keys(self.spark, [self.path(p.path) for p in parts], self.path(part.path), level, self.fan)
            return part
        rows = self.read(parts, table)
        if table == "merchant_grams":  # names that several batches have, once
            once = rows.groupBy("gram", "merchant_name").agg(F.max("batch_id").alias("batch_id"))
            once.sortWithinPartitions("gram", "merchant_name").write.options(**COMPACT).parquet(self.path(part.path))
            return part
        if table != "transactions":
            rows.write.options(**COMPACT).parquet(self.path(part.path))  # a scan packs small files into one task
            return part
        size = sum(size_of(self.spark, self.path(p.path)) for p in parts)
        by_day = size >= self.day_bytes and size >= self.day_bytes * rows.select("transacted_date").distinct().count()
        sized = rows.hint("rebalance", "transacted_date") if by_day else rows
        writer = sized.sortWithinPartitions("transacted_date", "account_id").write.options(**ID_BLOOM_FILTERS)
        (writer.partitionBy("transacted_date") if by_day else writer).parquet(self.path(part.path))
        return part._replace(key=BY_DAY) if by_day else part

    # transactions

    def transactions(self) -> DataFrame:
        """Every stored transaction. A range of days reads only those day folders of large merged parts, and skips
        row groups of the others, whose files are sorted by day."""
        return self.table("transactions")

    def put_transactions(self, rows: DataFrame, batch_id: int) -> Part:
        """Few files per batch: small pieces of a scan or a shuffle are merged by Spark, and nothing else is moved."""
        return self.put("transactions", rows.sortWithinPartitions("transacted_date", "account_id"), batch_id)

    def put_worked(self, worked: DataFrame, batch_id: int) -> tuple[Part, DataFrame | None, str]:
        """Rows of ``later_stages`` in one pass: the sound ones as a part of the transactions; the broken ones, if any,
        for the dead letters; and where the latter stand until the batch is committed."""
        whole = self._new("transactions", 0, batch_id, batch_id)
        broken = F.col("failed_stage").isNotNull()
        context = [F.when(broken, F.col(name)).alias(name) for name in BROKEN_CONTEXT]
        rows = worked.select(*transaction_columns(batch_id), *context, broken.alias("broken"))
        rows = rows.withColumn("transacted_date", F.when(~F.col("broken"), F.col("transacted_date")))
        ordered = rows.sortWithinPartitions("broken", "transacted_date", "account_id")
        ordered.write.options(**COMPACT).partitionBy("broken").parquet(self.path(whole.path))
        made = names_in(self.spark, self.path(whole.path))
        good, bad = (f"{whole.path}/broken={value}" for value in ("false", "true"))
        if "broken=false" in made:
            part = whole._replace(path=good)
        else:
            part = self.put("transactions", self.spark.createDataFrame([], S.TRANSACTION_SCHEMA), batch_id)
        read = None
        if "broken=true" in made:
            read = worked.sparkSession.read.schema(rows.drop("broken").schema).parquet(self.path(bad))
        return part, read, self.path(bad)

    def write_transactions(self, rows: DataFrame, batch_id: int) -> None:
        self.manifest.commit([self.put_transactions(rows, batch_id)])

    def compact_transactions(self, up_to_batch: int) -> None:
        """Merge all parts that were not merged yet, up to a batch, into one. Merged ones are not touched, so the cost
        follows the new rows only. Bloom filters on the two ids let a point lookup skip row groups."""
        fresh = [p for p in self.parts("transactions") if p.level == 0 and p.last <= up_to_batch]
        if fresh:
            self.manifest.commit([self._merged(fresh)], drop=fresh)
        self.merge(up_to_batch + 1, "transactions")

    # source records

    def put_payloads(self, rows: DataFrame, batch_id: int) -> Part:
        """The source records of transactions, parsed once. A payload that is no JSON becomes null."""
        parsed = rows.select("source_id", "source_type", F.try_parse_json("raw_payload").alias("payload"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        return self.put("payloads", parsed, batch_id)

    def payloads(self) -> DataFrame:
        return self.table("payloads")

    # merchant names

    def put_merchants(self, rows: DataFrame, batch_id: int) -> Part:
        """Trigram postings of the distinct merchant names of a batch, sorted so that a search skips most row groups."""
        sorted_ = postings(rows).withColumn("batch_id", F.lit(batch_id).cast("bigint")).hint("rebalance", "gram")
        return self.put("merchant_grams", sorted_.sortWithinPartitions("gram", "merchant_name"), batch_id)

    def merchants_with(self, term: str) -> DataFrame:
        """Distinct merchant names of the store that contain a text, in any case."""
        return names_with(self.table("merchant_grams"), term)

    # keys

    def put_keys(self, table: str, rows: DataFrame, batch_id: int, key: str | None = None) -> Part:
        """Keys (key, seen_at) of a batch as a part of an index that is not committed yet."""
        part = self._new(table, 0, batch_id, batch_id, key)
        K.write_keys(rows, self.path(part.path), 0, self.fan)
        return part

    def known(self, table: str, keys: DataFrame, batch_id: int, since=None, place: str | None = None) -> DataFrame:
        """Those of the distinct keys (a stored table) that batches other than this one have left in the index; written
        below ``place``, if there are many."""
        levels: dict[int, list[str]] = {}
        for part in self.parts(table):
            if part.level or part.first != batch_id:
                levels.setdefault(part.level, []).append(self.path(part.path))
        return K.known_keys(keys, levels, self.fan, since, place)

    # other tables of a batch

    def dead_letters(self) -> DataFrame:
        return self.table("dead_letters")

    def outcomes(self) -> DataFrame:
        return self.table("outcomes")

    def categorised_events(self) -> DataFrame:
        return self.table("categorised_events")

    def accepted(self) -> DataFrame:
        return self.table("accepted")

    # rollup: a base by month, plus one daily part per batch since

    def write_rollup_part(self, daily: DataFrame, batch_id: int) -> None:
        self.write("rollup_parts", daily.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    def rollup(self, period_types: tuple[str, ...] = S.PERIOD_TYPES) -> DataFrame:
        """The current rollup: base plus the parts since."""
        parts = self.parts("rollup_base", "rollup_parts")
        base = [p for p in parts if p.table == "rollup_base"]
        daily = merge_daily(self.read([p for p in parts if p.table == "rollup_parts"], "rollup_parts"))
        fresh = expand_periods(daily, period_types)
        if not base:
            return fresh
        return merge_rollups(self.read(base, "rollup_base").where(F.col("period_type").isin(*period_types)), fresh)

    def compact_rollup(self, up_to_batch: int) -> None:
        """Fold the parts up to a batch into the base. Only the months they touch are written anew; the others keep
        their files. A period belongs to the month it begins in."""
        parts = self.parts("rollup_base", "rollup_parts")
        folded = [p for p in parts if p.table == "rollup_parts" and p.last <= up_to_batch]
        if not folded:
            return
        month = F.coalesce(F.date_format("period_date", "yyyy-MM"), F.lit("none"))
        fresh = expand_periods(merge_daily(self.read(folded, "rollup_parts")))
        touched = {r.month for r in fresh.select(month.alias("month")).distinct().collect()}  # a row per month
        old = [p for p in parts if p.table == "rollup_base" and p.key in touched]
        merged = merge_rollups(self.read(old, "rollup_base"), fresh) if old else fresh
        place = self._new("rollup_base", 1, min(p.first for p in folded), max(p.last for p in folded))
        (
            merged.withColumn("month", month)
            .hint("rebalance", "month")
            .sortWithinPartitions("month", "period_type", "account_id", "period_date")
            .write.partitionBy("month")
            .parquet(self.path(place.path))
        )
        new = [place._replace(path=f"{place.path}/month={m}", key=m) for m in sorted(touched)]
        self.manifest.commit(new, drop=folded + old)

    def maintain(self, below: int) -> None:
        """What a job does after each batch: merge what is due, and fold rollup parts once there are ``fan``."""
        self.merge(below, *(t for t in SCHEMAS if not t.startswith("rollup")), IDS, RECORD_KEYS, RECENT_IDS, RECENT_RECORDS)
        if sum(p.last < below for p in self.parts("rollup_parts")) >= self.fan:
            self.compact_rollup(below - 1)


def to_transactions(categorised: DataFrame, batch_id: int | Column = 0) -> DataFrame:
    """Rows of the transactions table. Audit times are the arrival time and the id is derived
    from the source id, so a replay writes identical rows."""
    return categorised.select(*transaction_columns(batch_id))


def transaction_columns(batch_id: int | Column) -> list[Column]:
    """Columns of the transactions table made of categorised rows."""
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    return [
        *[F.col(name) for name in S.NORMALISED_SCHEMA.names],
        stable_id(F.col("source_id")).alias("external_id"),
        F.col("category_id"),
        F.col("category_tier"),
        F.col("ingested_at").alias("created_at"),
        F.col("ingested_at").alias("updated_at"),
        batch.cast("bigint").alias("batch_id"),
        F.to_date("transacted_at").alias("transacted_date"),
    ]


def to_dead_letters(rejected: DataFrame, stage: str | Column = "validation", batch_id: int | Column = 0) -> DataFrame:
    """Rejected rows with every reason, where they came from and the stage they failed at."""
    stage = stage if isinstance(stage, Column) else F.lit(stage)
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    return rejected.select(
        *S.NORMALISED_SCHEMA.names,
        "ingested_at",
        F.to_json(F.struct("arrival_seq")).alias("origin"),
        stage.alias("stage"),
        "reject_reason",
        "reject_reasons",
        batch.cast("bigint").alias("batch_id"),
    )


def accepted_events(transactions: DataFrame) -> DataFrame:
    """Accepted transactions as topic rows keyed by source id."""
    return transactions.select(
        F.col("source_id").alias("key"),
        F.to_json(F.struct(*S.NORMALISED_SCHEMA.names), EVENT_FORMAT).alias("value"),
    )


def categorised_events(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Stored transactions as topic rows that carry the category and its tier."""
    return event_value(with_category(transactions, categories)).select(F.col("source_id").alias("key"), "value")


def write_topic(events: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Batch write of topic rows to Kafka (needs the spark-sql-kafka package)."""
    (
        events.write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic)
        .save()
    )
