"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into lines and, so that a small edit of a long line stays small, each line further after
every word whose hash is divisible by ``CUT``; each part goes with the white space before it, so
the parts make up the whole text. The digests of the parts (a repeat counts as another digest) are
put into the cells of a sketch: a count, the XOR of the digests and the XOR of their check values. A text's fingerprint is its
sketch, with cells as its length asks for, a power of two. Two fingerprints are folded to the smaller one's cells and
subtracted; what both hold cancels out, and peeling cells with a single digest recovers the
digests by which they differ. If peeling gets stuck, both texts are sketched again with twice the cells.

The likeness of two fingerprints is 1 - differing digests / all digests of both (1 if both are empty).

Edge cases: null text is empty text, without digests and with an all-zero fingerprint; equal texts have
equal fingerprints; repeated rows are each fingerprinted; rows that share a doc_id follow each other by
text, and rows with a null doc_id come last; a table of one row is its own neighbour; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.llm.arrays import (
    EXACT,
    NOT_SPACE,
    U64,
    constants,
    mix,
    pieces,
    quiet,
    ranges,
    span_hashes,
    spans,
    text_column,
)
from centsible.llm.frames import map_batches, pieces_for, quantile_cuts, ship_package, written

CUT = 3
TABLES = 3
#: Bytes of input, as stored, in a range of ids; there are MOST_RANGES at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 15
#: Ranges of equally many rows are put together to ranges of about equal size from so many times as many.
FINER = 4
SEEDS = constants(TABLES, 301)
CHECK = constants(1, 401)[0]
REPEAT = constants(1, 501)[0]


def paragraph_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of every text and where each text begins among them."""
    found, count = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, data, begin in pieces(texts):
        starts, ends, first = spans(NOT_SPACE[data], begin)
        words = span_hashes(data, starts, ends, EXACT)
        row_end = begin[1:]
        line_end = np.zeros(len(words), bool)
        if len(words):
            breaks = np.flatnonzero(data == 10)
            upto = np.append(starts[1:], len(data))
            line_end = np.searchsorted(breaks, upto) > np.searchsorted(breaks, ends)
        last = np.zeros(len(words), bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        cut = np.flatnonzero((words % U64(CUT) == 0) | line_end | last)
        # a text's last part reaches to its end; one of white space only is a single part
        stop = ends[cut]
        owner = np.searchsorted(first, cut, "right") - 1
        final = last[cut]
        stop[final] = row_end[owner[final]]
        bare = np.flatnonzero((first[1:] == first[:-1]) & (begin[1:] > begin[:-1]))
        stop, owner = np.concatenate((stop, row_end[bare])), np.concatenate((owner, bare))
        order = np.argsort(stop, kind="stable")
        stop, owner = stop[order], owner[order]
        start = np.empty(len(stop), np.int64)
        start[1:] = stop[:-1]
        opens = np.ones(len(stop), bool)
        opens[1:] = owner[1:] != owner[:-1]
        start[opens] = begin[owner[opens]]
        digests = span_hashes(data, start, stop, EXACT)
        # the n-th repeat of a part is a digest of its own
        order = np.lexsort((digests, owner))
        same = np.zeros(len(digests), bool)
        same[1:] = (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        at = np.arange(len(digests))
        repeat = at - np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at
        own = digests[order]
        own[repeat > 0] = mix(own[repeat > 0] + repeat[repeat > 0].astype(U64) * REPEAT)
        found.append(own)
        count.append(np.bincount(owner, minlength=len(begin) - 1))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(count))))


def _cells(digests: np.ndarray, base: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The digest's cell in each table of its sketch, which begins at ``base`` with ``size`` cells a table."""
    return [
        base + j * size + ((mix(digests + SEEDS[j]) >> U64(33)) * size.astype(U64) >> U64(31)).astype(np.int64)
        for j in range(TABLES)
    ]


class Sketches:
    """The cells of many sketches in a row."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.base = np.concatenate(([0], np.cumsum(TABLES * sizes)))
        self.count = np.zeros(self.base[-1], np.int32)
        self.key = np.zeros(self.base[-1], U64)
        self.check = np.zeros(self.base[-1], U64)

    def add(self, digests: np.ndarray, owner: np.ndarray, sign) -> None:
        check = mix(digests ^ CHECK)
        for cell in _cells(digests, self.base[owner], self.sizes[owner]):
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, digests)
            np.bitwise_xor.at(self.check, cell, check)

    def recover(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The recovered digests, their sketches and their signs, and which sketches were emptied by it."""
        found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        while True:
            single = np.flatnonzero(np.abs(self.count) == 1)
            single = single[mix(self.key[single] ^ CHECK) == self.check[single]]
            if not len(single):
                break
            owner = np.searchsorted(self.base, single, "right") - 1
            digests = self.key[single]
            _, once = np.unique(mix(digests + owner.astype(U64) * REPEAT), return_index=True)
            digests, owner, sign = digests[once], owner[once], self.count[single][once]
            found.append((digests, owner, sign))
            self.add(digests, owner, -sign)
        left = np.concatenate(([0], np.cumsum((self.count != 0) | (self.key != 0) | (self.check != 0))))
        return *(np.concatenate(part) for part in zip(*found)), left[self.base[1:]] == left[self.base[:-1]]

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """How many digests were recovered from each sketch, and which sketches were emptied by it."""
        _, owner, _, emptied = self.recover()
        return np.bincount(owner, minlength=len(self.sizes)), emptied


def _owned(digests, begin, rows):
    count = begin[rows + 1] - begin[rows]
    return digests[ranges(begin[rows], count)], np.repeat(np.arange(len(rows)), count)


def differences(a, a_rows, b, b_rows) -> np.ndarray:
    """Number of digests by which text ``a_rows[i]`` of a and ``b_rows[i]`` of b differ. a, b: (digests, begins).

    The first sketches are the fingerprints of both, folded to the smaller one's cells."""
    out = np.zeros(len(a_rows), np.int64)
    waiting = np.arange(len(a_rows))
    sizes = np.minimum(_sizes(np.diff(a[1]))[a_rows], _sizes(np.diff(b[1]))[b_rows])
    while len(waiting):
        sketches = Sketches(sizes[waiting])
        for side, rows, sign in ((a, a_rows, 1), (b, b_rows, -1)):
            digests, owner = _owned(*side, rows[waiting])
            sketches.add(digests, owner, np.int32(sign))
        recovered, emptied = sketches.peel()
        out[waiting[emptied]] = recovered[emptied]
        waiting = waiting[~emptied]
        sizes[waiting] *= 2
    return out


def likeness(a, a_rows, b, b_rows) -> np.ndarray:
    total = np.diff(a[1])[a_rows] + np.diff(b[1])[b_rows]
    return 1.0 - differences(a, a_rows, b, b_rows) / np.maximum(total, 1)


def shown(side) -> list[str]:
    """The fingerprints as text: counts, XORs of the digests and of their checks of all cells, in hex."""
    total = np.diff(side[1])
    made = Sketches(_sizes(total))
    made.add(*_owned(*side, np.arange(len(total))), np.int32(1))
    return [data.hex() for data in _packed(made)]


def differing(fingerprint: str, other: str) -> int | None:
    """By how many digests two given fingerprints differ; None if their cells are too few to tell."""
    sides = [bytes.fromhex(text) for text in (fingerprint, other)]
    size = min(_cells_of(data) for data in sides)
    left = Sketches(np.array([size]))
    for data, sign in zip(sides, (1, -1)):
        count, key, check = _unpacked(data, size)
        left.count += sign * count
        left.key ^= key
        left.check ^= check
    with quiet():
        recovered, emptied = left.peel()
    return int(recovered[0]) if emptied[0] else None


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_digests and fingerprint of every text."""

    def run(batches):
        for batch in batches:
            with quiet():
                side = paragraph_digests(text_column(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(side[1])), pa.array(shown(side), pa.string())],
                    ["doc_id", "n_digests", "fingerprint"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_digests long, fingerprint string")


# ---- the digests by which two versions differ ------------------------------------------------

CELL_BYTES = 20


def _sizes(total: np.ndarray) -> np.ndarray:
    """Cells per table for texts with so many digests: doublings of 4, so that sketches fold to each other's size."""
    return 4 << np.ceil(np.log2(np.maximum(1, (total // 8 + 1) / 4))).astype(np.int64)


def _packed(sketches: Sketches) -> list[bytes]:
    ends = zip(sketches.base, sketches.base[1:])
    return [
        sketches.count[a:b].astype("<i4").tobytes() + sketches.key[a:b].astype("<u8").tobytes() + sketches.check[a:b].astype("<u8").tobytes()
        for a, b in ends
    ]


def _cells_of(data: bytes) -> int:
    return len(data) // (CELL_BYTES * TABLES)


def _unpacked(data: bytes, size: int) -> list[np.ndarray]:
    """count, key and check of a stored sketch, folded to a smaller size: neighbouring cells become one."""
    n = _cells_of(data) * TABLES
    parts = [np.frombuffer(data, "<i4", n), np.frombuffer(data, "<u8", n, 4 * n), np.frombuffer(data, "<u8", n, 12 * n)]
    times, rest = divmod(_cells_of(data), size)
    if rest or times & (times - 1):
        raise ValueError("sketches fold to half their cells only")
    folds = (np.add, np.bitwise_xor, np.bitwise_xor)
    return [fold.reduce(part.reshape(n // times, times), axis=1, dtype=part.dtype) for fold, part in zip(folds, parts)]


def sketches(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, n_digests and the sketch of every text, to be stored; its cells per table follow the text's length
    if they are not given."""

    def run(batches):
        for batch in batches:
            with quiet():
                side = paragraph_digests(text_column(batch))
                total = np.diff(side[1])
                made = Sketches(_sizes(total) if cells is None else np.full(len(total), cells))
                made.add(*_owned(*side, np.arange(len(total))), np.int32(1))
                columns = [batch.column(0), pa.array(total), pa.array(_packed(made), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_digests", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_digests long, sketch binary")


def _lists(digests, owner, rows: int) -> pa.Array:
    order = np.lexsort((digests.view(np.int64), owner))
    begin = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(digests[order].view(np.int64)))


def _judged(ids: pa.Array, digests, owner, sign, emptied) -> pa.RecordBatch:
    kept = emptied[owner]
    old, new = kept & (sign > 0), kept & (sign < 0)
    lists = [_lists(digests[side], owner[side], len(emptied)) for side in (old, new)]
    return pa.RecordBatch.from_arrays([ids, *lists, pa.array(emptied)], ["doc_id", "removed", "added", "emptied"])


def subtracted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored ``sketches`` of two versions -> doc_id, the digests ``removed`` and ``added``, and ``emptied``: false where
    the cells were too few to recover them (both are empty then). A document that one version lacks is empty there."""
    kind = old.schema["doc_id"].dataType.simpleString()
    a, b = old.select("doc_id", "sketch"), new.select(F.col("doc_id").alias("new_id"), F.col("sketch").alias("new_sketch"))
    pairs = a.join(b, a["doc_id"].eqNullSafe(b["new_id"]), "full")
    pairs = pairs.select(F.coalesce("doc_id", "new_id").alias("doc_id"), "sketch", "new_sketch")

    def run(batches):
        for batch in batches:
            both = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            size = np.array([min(_cells_of(x) for x in pair if x is not None) for pair in both], np.int64)
            left = Sketches(size)
            for pair, n, base, end in zip(both, size.tolist(), left.base, left.base[1:]):
                for data, sign in zip(pair, (1, -1)):
                    if data is not None:
                        count, key, check = _unpacked(data, n)
                        left.count[base:end] += sign * count
                        left.key[base:end] ^= key
                        left.check[base:end] ^= check
            with quiet():
                yield _judged(batch.column(0), *left.recover())

    return map_batches(pairs, run, f"doc_id {kind}, removed array<long>, added array<long>, emptied boolean")


def version_differences(old: DataFrame, new: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id and the paragraph digests ``removed`` and ``added`` between two versions (doc_id, text) of documents.

    The sketches of both are subtracted and peeled; the texts of the pairs where that gets stuck, and of no others,
    are sketched again with twice the cells until all is recovered. A version has one row per doc_id.
    """
    for side in (old, new):
        if not side.groupBy("doc_id").count().where("count > 1").isEmpty():
            raise ValueError("a doc_id is repeated within a version")
    kind = old.schema["doc_id"].dataType.simpleString()
    first = written(subtracted(sketches(old, cells), sketches(new, cells)), "differences")
    done = first.where("emptied").select("doc_id", "removed", "added")
    failed = first.where("NOT emptied").select(F.col("doc_id").alias("id"))
    texts = failed.join(old.select("doc_id", "text"), F.col("id").eqNullSafe(F.col("doc_id")), "left").select("id", "text")
    other = new.select(F.col("doc_id").alias("new_id"), F.col("text").alias("new_text"))
    pairs = texts.join(other, F.col("id").eqNullSafe(F.col("new_id")), "left").select("id", "text", "new_text")

    def run(batches):
        for batch in batches:
            with quiet():
                a, b = (paragraph_digests(batch.column(n).cast(pa.large_string())) for n in (1, 2))
                waiting = np.arange(batch.num_rows)
                begun = np.maximum(*(_sizes(np.diff(x[1])) for x in (a, b))) if cells is None else np.full(len(waiting), cells)
                sizes = 2 * begun
                while len(waiting):
                    left = Sketches(sizes[waiting])
                    for side, sign in ((a, 1), (b, -1)):
                        left.add(*_owned(*side, waiting), np.int32(sign))
                    *recovered, emptied = left.recover()
                    judged = _judged(batch.column(0).take(pa.array(waiting)), *recovered, emptied)
                    yield judged.filter(pa.array(emptied)).select(["doc_id", "removed", "added"])
                    waiting = waiting[~emptied]
                    sizes[waiting] *= 2

    return done.unionByName(map_batches(pairs, run, f"doc_id {kind}, removed array<long>, added array<long>"))


# ---- a document, its edited version and its neighbour ---------------------------------------


def _window(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all rows but the last, each with the text after it as the neighbour."""
    edited = []
    for text, after in zip(texts, texts[1:]):
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + after[:cut])
    with quiet():
        own, new = paragraph_digests(pa.array(texts, pa.large_string())), paragraph_digests(pa.array(edited, pa.large_string()))
        rows = np.arange(len(edited))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(shown(own)[:-1], pa.string()),
            pa.array(shown(new), pa.string()),
            pa.array(likeness(own, rows, new, rows)),
            pa.array(likeness(own, rows, own, rows + 1)),
        ]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in EDITED])


EDITED = [
    ("doc_id", "long"),
    ("n_chars", "long"),
    ("edited_sha256", "string"),
    ("fingerprint", "string"),
    ("edited_fingerprint", "string"),
    ("near_edited", "double"),
    ("near_next", "double"),
]
#: Characters of text that are worked on at once.
AT_ONCE = 1 << 20


def _neighbours(batches):
    """Rows of a range in order, then the first row of the next range (``closing``), several ranges in turn."""
    last = None
    for batch in batches:
        at = batch.schema.get_field_index
        part, closing = (batch.column(at(n)).to_pylist() for n in ("part", "closing"))
        ids, texts = batch.column(at("doc_id")).to_pylist(), batch.column(at("text")).to_pylist()
        run_ids, run_texts, size = [], [], 0
        if last:
            run_ids, run_texts = [last[1]], [last[2]]
        for p, c, i, t in zip(part, closing, ids, texts):
            t = t or ""
            if last is None:
                if c:
                    continue  # a tie of the closing row
                run_ids, run_texts, size, last = [i], [t], 0, (p, i, t)
                continue
            run_ids.append(i)
            run_texts.append(t)
            size += len(t)
            last = None if c else (p, i, t)
            if c or size > AT_ONCE:
                yield _window(run_ids[:-1], run_texts)
                run_ids, run_texts, size = (run_ids[-1:], run_texts[-1:], 0) if last else ([], [], 0)
        if len(run_texts) > 1:
            yield _window(run_ids[:-1], run_texts)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its edited version: the last third replaced by as much of the next document, by
    descending doc_id (after the last comes the first).

    The ids are split into ranges of about as many bytes; a range's first row is also
    sent to the range before it, so that every task finds the next row of its last one. Only the ids and the lengths
    are read for that, and the texts are shuffled once. Rows that share a doc_id stay in one range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = min(pieces_for(docs, RANGE_BYTES), MOST_RANGES)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"))
    held = spark.sparkContext.broadcast(np.array(quantile_cuts(ids, "doc_id", FINER * parts), np.int64))  # a number per cut

    def ranges_by(numbers):
        """Which range each id is in; ``numbers`` has it for each place among the cuts, and for null ids last."""

        @F.pandas_udf("int")
        def range_of(values):
            known = values.notna().to_numpy()
            place = np.full(len(values), len(held.value) + 1, np.int64)
            whole = values.to_numpy()[known].astype(np.int64)
            place[known] = len(held.value) - np.searchsorted(held.value, whole, "right")
            return _series(numbers.value[place])

        return range_of

    finest = spark.sparkContext.broadcast(np.arange(len(held.value) + 2, dtype=np.int32))
    sizes = ids.groupBy(ranges_by(finest)("doc_id").alias("part")).agg(F.max("doc_id").alias("head"), F.sum("size").alias("size"))
    fine = sizes.orderBy("part").collect()  # a row per cut
    if not fine:
        empty = ", ".join(f"{name} {kind}" for name, kind in EDITED)
        return spark.createDataFrame([], empty)
    enough = sum(r["size"] or 0 for r in fine) / parts
    merged, heads, filled = np.zeros(len(held.value) + 2, np.int32), [], enough
    for r in fine:
        if filled >= enough:
            heads.append(r["head"])
            filled = 0
        merged[r["part"]] = len(heads) - 1
        filled += r["size"] or 0
    range_of = ranges_by(spark.sparkContext.broadcast(merged))
    links = [(part, head, (part - 1) % len(heads)) for part, head in enumerate(heads)]
    links = spark.createDataFrame(links, "part int, head long, to int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("part", range_of("doc_id"))
    rows = rows.join(F.broadcast(links), "part")  # one row per range
    places = F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("closing")),
        F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.struct(F.col("to").alias("part"), F.lit(True).alias("closing"))),
    )
    sent = rows.select("doc_id", "text", F.explode(F.array_compact(places)).alias("place"))
    sent = sent.select("place.part", "place.closing", "doc_id", "text")
    in_order = sent.repartitionById(len(heads), "part").sortWithinPartitions(
        "part", "closing", F.col("doc_id").desc_nulls_last(), "text"
    )
    return map_batches(in_order, _neighbours, ", ".join(f"{name} {kind}" for name, kind in EDITED))


def _series(values):
    import pandas as pd

    return pd.Series(values)
