"""Duplicate removal: the first arrival of a key wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from centsible.operators.validate import Rule, valid_rows
from centsible.schemas import ACCEPTED, DUPLICATE, FAILED, OUTCOMES, REPEATED
from centsible.session import COMPACT, scratch_path
from centsible.sources.adapters import ADAPTERS

#: Numbers of rows are broadcast as bits for batches of at most so many rows: 128 MB.
MOST_MARKED = 1 << 30


def first_wins(df: DataFrame, key: str, order: str = "arrival_seq") -> DataFrame:
    """Keep the first row of every key.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle too, so
    a key with a third of all rows sends at most one row per input task.
    """
    position = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a table in the shared folder with a number each (``_row``), and how many there are."""
    path, seen = scratch_path(df.sparkSession, "arrived"), Observation()
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**COMPACT).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path), seen.get["rows"]


def first_wins_written(df: DataFrame, key: str, order: str = "arrival_seq") -> DataFrame:
    """The same for rows that are stored whole. They are written once with a number each; only keys, places and numbers are
    shuffled and sorted, and the first rows are picked by their numbers where they stand."""
    rows, n_rows = numbered(df)
    firsts = rows.groupBy(key).agg(F.min(F.struct(order, "_row")).alias("_first"))
    return with_mark(rows, "_row", firsts.select(F.col("_first._row").alias("row")), n_rows).where("_marked").drop("_marked", "_row")


def drop_source_repeats(raw: DataFrame, source_type: str, order: str = "arrival_seq") -> DataFrame:
    """Source-level duplicate check on the raw record key (for payments: the event id, so a
    resent event is dropped before its payment id is looked at). Rows without a key pass on
    to validation, which rejects them."""
    key = ADAPTERS[source_type].record_key
    keyed = first_wins(raw.where(F.col(key).isNotNull()), key, order)
    return keyed.unionByName(raw.where(F.col(key).isNull()))


def drop_stored(
    batch: DataFrame, stored: DataFrame, key: str = "source_id", keys: DataFrame | None = None
) -> DataFrame:
    """Remove rows whose key is already stored.

    The stored side can be huge and the batch is not, so the stored ids are first reduced to
    those of this batch (only the key column is read; the batch's ids are broadcast when AQE
    finds them small, else both sides are shuffled) and only the hits are joined back. ``keys``
    may name a cheaper source of the batch's keys than the batch itself.
    """
    wanted = (batch if keys is None else keys).select(key).distinct()
    hits = stored.select(key).join(wanted, key, "left_semi").distinct()
    return batch.join(hits, key, "left_anti")


def repeated_rows(rows: DataFrame, firsts: DataFrame, known: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """row, source_type of the rows that are not the first of a key that is not known.

    ``firsts`` (a stored table: key, row) names the first row of each key and ``known`` (key) those of them that were seen
    before. Only numbers of rows are compared here, so a key with many copies is as good as any other.
    """
    new = firsts if known is None else firsts.join(known, "key", "left_anti")
    return without_rows(rows.select("arrival_seq", "source_type"), new, n_rows).select(F.col("arrival_seq.row").alias("row"), "source_type")


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, row: the number of each key's first row by place of arrival. A hot key is one row per task in the shuffle."""
    first = rows.groupBy(F.col(key).alias("key")).agg(F.min("arrival_seq").alias("_first"))
    return first.select("key", F.col("_first.row").alias("row"))


def row_bits(numbers: DataFrame) -> DataFrame:
    """block, words: numbers of rows (row) as bits, 64 words of 64 rows in a block. Numbers that Spark gives within a task follow
    each other, so a table of many rows is about a bit for each of them."""
    word, bit = F.shiftright("row", 6).alias("word"), F.expr("shiftleft(1L, CAST(row & 63 AS INT))")
    words = numbers.groupBy(word).agg(F.bit_or(bit).alias("mask"))
    marked = F.map_from_entries(F.collect_list(F.struct((F.col("word").bitwiseAND(63)).alias("word"), "mask"))).alias("marked")
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(marked)
    return blocks.select("block", F.expr("transform(sequence(0L, 63L), i -> coalesce(try_element_at(marked, i), 0L))").alias("words"))


def with_mark(rows: DataFrame, row: str, numbers: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Add ``_marked``: whether the row's number (``row``) is in a table (row). No row is moved for it, however many are marked:
    their numbers are broadcast as bits. Beyond ``MOST_MARKED`` numbered rows (``n_rows``; None: not known) Spark chooses the
    join by its sizes."""
    bits = row_bits(numbers).withColumnsRenamed({"block": "_block", "words": "_words"})
    bits = F.broadcast(bits) if n_rows is not None and n_rows <= MOST_MARKED else bits
    joined = rows.join(bits, F.shiftright(row, 12) == F.col("_block"), "left")
    bit = F.expr(f"getbit(_words[CAST(shiftright({row}, 6) & 63 AS INT)], CAST({row} & 63 AS INT))")
    return joined.withColumn("_marked", F.coalesce(bit == 1, F.lit(False))).drop("_block", "_words")


def without_rows(rows: DataFrame, gone: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Rows but those whose number is in a table (row, ...)."""
    return with_mark(rows, "arrival_seq.row", gone.select("row"), n_rows).where("NOT _marked").drop("_marked")


def classify_outcomes(
    df: DataFrame, rules: list[Rule], key: str = "source_id", order: str = "arrival_seq"
) -> DataFrame:
    """Mark every row FAILED, ACCEPTED or DUPLICATE in ``outcome`` without dropping any.

    The rows are written once with a number each, so that copies that are alike can be told apart, however often a record
    was sent. The first row of each valid key is a grouped minimum, and its number marks it; the written rows are not
    shuffled. Rows that arrive at the same place but differ are ordered by their other columns.
    """
    others = [name for name in df.columns if name not in (key, order)]
    failed = F.coalesce(F.expr(" OR ".join(f"coalesce({broken}, false)" for _, broken in rules)), F.lit(False))
    rows, n_rows = numbered(df.withColumn("_failed", failed))
    place = F.struct(order, *others, "_row")
    firsts = rows.where("NOT _failed").groupBy(key).agg(F.min(place).alias("_first"))
    marked = with_mark(rows, "_row", firsts.select(F.col("_first._row").alias("row")), n_rows)
    outcome = F.when(F.col("_failed"), FAILED).when(F.col("_marked"), ACCEPTED).otherwise(DUPLICATE)
    return marked.select(*df.columns, outcome.alias("outcome"))


def count_outcomes(
    df: DataFrame, rules: list[Rule], key: str = "source_id", order: str = "arrival_seq"
) -> DataFrame:
    """Records per source and outcome, each counted by itself."""
    broken = " OR ".join(f"coalesce({condition}, false)" for _, condition in rules)
    failed = df.groupBy("source_type").agg(F.count_if(F.expr(broken)).alias("records"))
    firsts = count_firsts(valid_rows(df, rules), key, order)
    return outcome_rows(
        failed.select("source_type", F.lit(FAILED).alias("outcome"), "records"),
        firsts.select("source_type", F.lit(ACCEPTED).alias("outcome"), F.col("firsts").alias("records")),
        firsts.select("source_type", F.lit(DUPLICATE).alias("outcome"), F.col("repeats").alias("records")),
    )


def count_firsts(
    rows: DataFrame, key: str, order: str = "arrival_seq", known: DataFrame | None = None
) -> DataFrame:
    """source_type, firsts and repeats: how many rows are the first of a key that is not ``known`` (a table of one column
    named like the key), and how many are not. Rows are grouped by key and source before the first
    arrival of a key is looked for among its sources, so a hot key is one row per task in the shuffle."""
    per_source = rows.groupBy(key, "source_type").agg(F.count(F.lit(1)).alias("_copies"), F.min(order).alias("_at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_at", "source_type"))
    placed = per_source.withColumn("_place", place)
    if known is None:
        placed = placed.withColumn("_known", F.lit(False))
    else:
        placed = placed.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    first = F.when((F.col("_place") == 1) & ~F.coalesce("_known", F.lit(False)), 1).otherwise(0)
    return placed.groupBy("source_type").agg(F.sum(first).alias("firsts"), F.sum(F.col("_copies") - first).alias("repeats"))


def outcome_rows(*counts: DataFrame) -> DataFrame:
    """source_type, outcome, records from several counts: the three outcomes of each source, zero where nothing was
    counted, and repeated raw records where there are any."""
    rows = reduce(DataFrame.unionByName, counts)
    kinds = (*OUTCOMES, REPEATED)
    wide = rows.groupBy("source_type").agg(
        *[F.coalesce(F.sum(F.when(F.col("outcome") == kind, F.col("records"))), F.lit(0)).alias(kind) for kind in kinds]
    )
    return wide.unpivot("source_type", list(kinds), "outcome", "records").where(
        (F.col("outcome") != REPEATED) | (F.col("records") > 0)
    )
