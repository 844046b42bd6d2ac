"""Vector code compression: product codes whose codebooks are refined by an active-entry Lloyd iteration.

Vectors become whole numbers and are cut into equal consecutive parts; each part is replaced by the index of its
codebook's nearest entry. A round assigns all parts and then moves each entry to the mean of its parts. After a
round only some entries have moved:

* A part whose own entry stayed keeps its exact distance, stored with the row. No entry that stayed can have
  become nearer, so the part is compared with the moved entries only; an equal distance goes to the lower index.
* A part whose own entry moved is compared with all entries again.

Distances are whole numbers and exact, so the result is that of plain Lloyd rounds, and the same however Spark
splits the rows. One job per round reads the rows of the round before and writes them with their new indexes and
distances, and beside them one sum per task, entry and component. The codebooks, whose size does not depend
on the number of vectors, are all that passes the driver. The rows of a round are removed once those of the next are written.

Edge cases: a vector that is null or holds a null, NaN or infinite component is dropped. The width is that of the kept
vector with the smallest id; kept vectors of another width stay with null codes and take no part. A width that
the number of parts does not divide is filled up with zeros on the right. The first codebook takes rows in the order
of id (null last) and vector, so repeated ids and rows count as rows; with fewer rows than entries it has as many
entries as rows. Components beyond 2**62 after scaling count as 2**62; a distance or error beyond a long is the largest
long. An empty table gives no rows and no codebooks. Other columns stay; those named ``codes`` or ``error``
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import text_column
from centsible.llm.frames import OWN, brought_back, map_batches, set_aside, without, written, written_at
from centsible.sources.manifest import remove

LONGEST = (1 << 63) - 1
LARGEST_COMPONENT = (1 << 62) - 1
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: Distances of so many rows are worked out at once.
ROWS_AT_ONCE = 2048


@dataclass(frozen=True)
class Shape:
    """How vectors are scaled and cut."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def whole_numbers(vectors: np.ndarray, shape: Shape) -> np.ndarray:
    """(rows, width) floats -> (rows, parts, part width) whole numbers, floor(scale * x)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * shape.scale)
    clipped = np.where(np.abs(scaled) < float(LARGEST_COMPONENT), scaled, 0).astype(np.int64)
    clipped[scaled >= float(LARGEST_COMPONENT)] = LARGEST_COMPONENT
    clipped[scaled <= -float(LARGEST_COMPONENT)] = -LARGEST_COMPONENT
    wide = -(-vectors.shape[1] // shape.parts)
    filled = np.zeros((len(vectors), wide * shape.parts), np.int64)
    filled[:, : vectors.shape[1]] = clipped
    return filled.reshape(len(vectors), shape.parts, wide)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, d) parts to (k, d) entries as longs, the largest long if beyond."""
    if not len(x) or not len(entries) or not x.shape[1]:
        return np.zeros((len(x), len(entries)), np.int64)
    reach = int(max(x.max(), -x.min())) + int(max(entries.max(), -entries.min()))
    if x.shape[1] * reach * reach < EXACT:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    found = np.empty((len(x), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        apart = x - entry
        about = np.square(apart.astype(np.float64)).sum(1)
        with np.errstate(over="ignore"):
            found[:, k] = np.where(about >= float(LONGEST) * (1 - 1e-12), LONGEST, np.square(apart).sum(1))
    return found


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each part's nearest entry; the lower index of equals."""
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS_AT_ONCE):
        all_ = distances(x[a : a + ROWS_AT_ONCE], entries)
        index[a : a + ROWS_AT_ONCE] = all_.argmin(1)
        least[a : a + ROWS_AT_ONCE] = all_.min(1)
    return index, least


def nearest_again(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray, index: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``nearest``, given each part's index and distance before the marked entries moved."""
    index, least = index.copy(), least.copy()
    again = moved[index]
    if again.any():
        index[again], least[again] = nearest(x[again], entries)
    others = np.flatnonzero(moved)
    stayed = np.flatnonzero(~again)
    if len(others) and len(stayed):
        place, apart = nearest(x[stayed], entries[others])
        rival = others[place]
        wins = (apart < least[stayed]) | ((apart == least[stayed]) & (rival < index[stayed]))
        index[stayed[wins]], least[stayed[wins]] = rival[wins], apart[wins]
    return index, least


def _kept(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound


def _rows_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of the width, and these as an array."""
    column = text_column(batch, "vector")
    begin = column.offsets.to_numpy()
    fits = np.diff(begin) == width
    flat = column.values.slice(begin[0], begin[-1] - begin[0]).to_numpy(zero_copy_only=False)
    vectors = flat[np.repeat(fits, np.diff(begin))]
    return fits, vectors.reshape(int(fits.sum()), width)


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, width: int, shape: Shape, sums: bool) -> DataFrame:
    """One round over all rows: kind 0 are the rows with new codes and distances; kind 1, if asked for, the sums and
    counts (place -1) of a task's parts per entry."""
    held = rows.sparkSession.sparkContext.broadcast((books, moved))  # parts x entries x width numbers

    def run(batches):
        books, moved = held.value
        parts, entries, wide = books.shape
        # two halves of 32 bits each, so that no sum of a task overflows
        high, low = (np.zeros((parts * entries, wide), np.int64) for _ in range(2))
        count = np.zeros(parts * entries, np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            fits, vectors = _rows_of(batch, width)
            x = whole_numbers(vectors, shape)
            if moved is not None:
                old = [
                    text_column(batch, c).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                    for c in ("codes", "apart")
                ]
            codes, apart = (np.zeros((len(x), parts), np.int64) for _ in range(2))
            for p in range(parts):
                if moved is None:
                    codes[:, p], apart[:, p] = nearest(x[:, p], books[p])
                else:
                    codes[:, p], apart[:, p] = nearest_again(x[:, p], books[p], moved[p], old[0][:, p].astype(np.int64), old[1][:, p])
            if sums and len(x):
                slot = (codes + np.arange(parts) * entries).ravel()
                order = np.argsort(slot, kind="stable")
                flat = x.reshape(-1, wide)[order]
                there, first, n = np.unique(slot[order], return_index=True, return_counts=True)
                high[there] += np.add.reduceat(flat >> 32, first, axis=0)
                low[there] += np.add.reduceat(flat & 0xFFFFFFFF, first, axis=0)
                count[there] += n
            lists = [_lists(values, fits, kind) for values, kind in ((codes, pa.int32()), (apart, pa.int64()))]
            yield _batch(schema, batch.num_rows, 0, {n: text_column(batch, n) for n in ("id", "vector", OWN)} | {"codes": lists[0], "apart": lists[1]})
        used = np.flatnonzero(count)
        for a in range(0, len(used), ROWS_AT_ONCE):
            slots = used[a : a + ROWS_AT_ONCE]
            totals = [(int(h) << 32) + int(w) for h, w in zip(high[slots].ravel().tolist(), low[slots].ravel().tolist())]
            columns = {
                "slot": pa.array(np.concatenate((slots, np.repeat(slots, wide))).astype(np.int32)),
                "place": pa.array(np.concatenate((np.full(len(slots), -1), np.tile(np.arange(wide), len(slots)))).astype(np.int32)),
                "total": pa.array([*count[slots].tolist(), *totals], pa.decimal128(38, 0)),
            }
            yield _batch(schema, len(columns["slot"]), 1, columns)

    kinds = {"codes": "array<int>", "apart": "array<bigint>", "slot": "int", "place": "int", "total": "decimal(38,0)", "kind": "int"}
    out = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in ("id", "vector", OWN)])
    for name, kind in kinds.items():
        out = out.add(name, T._parse_datatype_string(kind))
    return map_batches(rows, run, out)


def _lists(values: np.ndarray, fits: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list per row, null for rows that do not fit."""
    sizes = np.where(fits, values.shape[1], 0)
    begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    # a null first offset marks a null list
    offsets = pa.array(begin, mask=np.append(~fits, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()).cast(kind))


def _batch(schema: pa.Schema, rows: int, kind: int, columns: dict) -> pa.RecordBatch:
    kinds = {n: schema.field(n).type for n in ("id", "vector", OWN)}
    kinds |= {"codes": pa.list_(pa.int32()), "apart": pa.list_(pa.int64()), "slot": pa.int32(), "place": pa.int32()}
    kinds |= {"total": pa.decimal128(38, 0)}
    arrays = [columns[n] if n in columns else pa.nulls(rows, t) for n, t in kinds.items()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(rows, kind, np.int32))], [*kinds, "kind"])


def _moved_on(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The codebooks after a round: floor of the mean; entries without parts stay."""
    parts, entries, wide = books.shape
    new = books.reshape(parts * entries, wide).copy()
    # one row per entry and component: as many as the codebooks have numbers
    rows = sums.groupBy("slot", "place").agg(F.sum("total").alias("total")).collect()
    count = {r.slot: int(r.total) for r in rows if r.place < 0}
    for r in rows:
        if r.place >= 0:
            new[r.slot, r.place] = int(r.total) // count[r.slot]
    return new.reshape(books.shape)


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", shape: Shape = Shape()
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): the kept rows with all their columns, ``codes`` (array of indexes, one per part) and
    ``error`` (long, squared distances summed over the parts); the last codebooks as (parts, entries, part width)."""
    vectors = without(vectors, "codes", "error")
    kept = vectors.where(_kept(F.col(vector_column)))
    aside = set_aside(kept, id_column, vector_column).withColumnsRenamed({id_column: "id", vector_column: "vector"})
    first = aside.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(shape.entries).collect()
    width = len(first[0].vector) if first else 0
    first = [r.vector for r in first if len(r.vector) == width]
    books = whole_numbers(np.array(first, np.float64).reshape(len(first), width), shape).transpose(1, 0, 2).copy()
    moved, rows, before = None, aside, None
    for turn in range(shape.rounds + 1 if first else 0):
        last = turn == shape.rounds
        made, place = written_at(_assigned(rows, books, moved, width, shape, not last), "vector-codes", "kind")
        if before:
            remove(vectors.sparkSession, before)
        before, rows = place, made.where("kind = 0").select("id", "vector", OWN, "codes", "apart")
        if not last:
            new = _moved_on(books, made.where("kind = 1"))
            moved, books = (new != books).any(axis=2), new
    if not first:
        rows = aside.withColumn("codes", F.lit(None).cast("array<int>")).withColumn("apart", F.lit(None).cast("array<bigint>"))
    named = rows.withColumnsRenamed({"id": id_column, "vector": vector_column})
    total = F.aggregate("apart", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    own = brought_back(named, kept, id_column, vector_column)
    return named.select(*own, "codes", _long(total).alias("error")), books


def _long(total: Column) -> Column:
    return F.when(total > LONGEST, LONGEST).otherwise(total).cast("bigint")


def code_text(codes: Column) -> Column:
    """The indexes in part order, two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def codebook_text(books: np.ndarray) -> str:
    """All components by part, entry and position, with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the error summed over all rows of the same label, null being one. The sums are a table, so
    that Spark knows its size: it is broadcast only if small, else the rows are shuffled and hot labels split."""
    total = _long(F.sum(F.col("error").cast("decimal(38,0)")))
    sums = written(rows.groupBy(F.col(label).alias("of_label")).agg(total.alias("label_error")), "label-errors")
    return rows.join(sums, rows[label].eqNullSafe(sums["of_label"])).drop("of_label")
