"""Line dedup: a line is dropped if an earlier line of the corpus is equal or one word away from it.

Lines are compared as sequences of words (A-Z lower-cased, white space only separates). With ``edits`` = 1 two lines are
near that one word inserted, deleted or replaced makes equal, if both have ``least_words`` words (two unless the caller
asks for more); with ``edits`` = 0 lines must be equal. "Earlier" is by doc_id, then by the text's hash, then by line
number; of each set of equal lines the first one stands for all.

Near lines are found by their deletion neighbourhood. Every line emits its hash, the hash of each
variant with one word deleted, and the same with the place of the deletion: a line that equals a variant of another is one insertion
away, and two lines with the same variant at the same place differ in that word only. Grouping
equal keys and keeping their earliest lines is enough to know each line's earlier neighbours, so no pairs
within a group are listed. All neighbours found this way are verified on the words themselves.

Two lines one word apart share nearly their first or nearly their last half. So only lines of which such a part
occurs in another line, a small part of all, emit variants, and only of the rest of the line. Lines of ``TINY`` words
at most have no such part and emit all their few variants.

Edge cases: blank lines and lines of null or empty texts are neither dropped nor compared; rows with equal doc_id and
text are one document and get the same decisions; a null doc_id comes last; an empty table gives no rows.
Lines are identified by a 64-bit hash, their number of words and of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import (
    LOWER,
    NOT_SPACE,
    U64,
    Runs,
    column,
    constants,
    mix,
    pieces,
    quiet,
    ranges,
    signed,
    spans,
    text_column,
)
from centsible.llm.bloom import BloomFilter
from centsible.llm.frames import brought_back, map_batches, set_aside, text_id, without, written

#: A line of two words is the shortest of which a word can be deleted.
LEAST_WORDS = 2
TINY = 4
FRONT, BACK, PLACED, PLACE = constants(4, 601)


def _lines(texts: pa.Array):
    """Per piece: row, line number, first and end word of each line that has words; word runs; bytes of the words."""
    for first_row, _, data, begin in pieces(texts):
        starts, ends, first = spans(NOT_SPACE[data], begin)
        if not len(starts):
            continue
        words = Runs(LOWER[data]).hashes(starts, ends)
        breaks = np.flatnonzero(data == 10)
        row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, begin)[row]
        opens = np.ones(len(starts), bool)
        opens[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        a = np.flatnonzero(opens)
        b = np.append(a[1:], len(starts))
        size = np.concatenate(([0], np.cumsum(ends - starts)))
        yield row[a] + first_row, line[a], a, b, Runs(words), size[b] - size[a]


def _middles(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the compared halves of a line of n words: its own, and that of a line of n - 1 words; 0 is none."""
    return n // 4 * 2, (n - 1) // 4 * 2


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with words: doc_id, tid, line, hash, n_words, n_bytes and the keys of its first and last parts."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            with quiet():
                for row, line, a, b, runs, n_bytes in _lines(text_column(batch)):
                    n = b - a
                    long = np.flatnonzero(n >= TINY)
                    la, lb = a[long], b[long]
                    own, other = _middles(n[long])
                    both = (own != other) & (other > 0)
                    size = np.concatenate((own, other[both]))
                    begin, end = np.concatenate((la, la[both])), np.concatenate((lb, lb[both]))
                    line_of = np.concatenate((long, long[both]))
                    order = np.argsort(line_of, kind="stable")
                    begin, end, size = begin[order], end[order], size[order]
                    columns = [
                        batch.column(at("doc_id")).take(pa.array(row)),
                        batch.column(at("tid")).take(pa.array(row)),
                        pa.array(line.astype(np.int32)),
                        pa.array(signed(runs.hashes(a, b))),
                        pa.array(n.astype(np.int32)),
                        pa.array(n_bytes.astype(np.int64)),
                    ]
                    opens = pa.array(np.searchsorted(line_of[order], np.arange(len(n) + 1)).astype(np.int32))
                    for keys in (runs.hashes(begin, begin + size) + FRONT, runs.hashes(end - size, end) + BACK):
                        columns.append(pa.ListArray.from_arrays(opens, pa.array(signed(mix(keys)))))
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "tid", "line", "hash", "n_words", "n_bytes", "fronts", "backs"]
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tid long, line int, hash long, n_words int, n_bytes long, fronts array<long>, backs array<long>"
    return map_batches(docs.select("doc_id", text_id().alias("tid"), "text"), run, schema)


def _at() -> Column:
    """Where a line stands; comparable, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid", "line")


LINE = ["hash", "n_words", "n_bytes"]


def _similar_lines(lines: DataFrame, least_words: int) -> DataFrame:
    """hash, front, back: the lines with a first or last part that another line has too, and which; and all tiny lines."""
    lines = lines.where(F.col("n_words") >= least_words)
    side = lambda name, front: F.transform(name, lambda k: F.struct(k.alias("part"), F.lit(front).alias("front")))
    parts = lines.select("hash", "n_words", F.inline(F.concat(side("fronts", True), side("backs", False))))
    shared = parts.groupBy("part").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high")
    similar = parts.where(F.col("n_words") > TINY).join(shared.select("part"), "part", "left_semi")
    similar = similar.groupBy("hash").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))
    tiny = lines.where(F.col("n_words") <= TINY).select("hash").distinct()
    return similar.union(tiny.select("hash", F.lit(False), F.lit(False)))


def _line_texts(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """doc_id, tid, line, front, back, text of the wanted lines (hash, doc_id, tid, line, front, back).

    A Bloom filter of the wanted hashes, of bounded size, keeps nearly all other lines out of the join.
    """
    held = docs.sparkSession.sparkContext.broadcast(BloomFilter.build(wanted.select("hash")).blocks)

    def run(batches):
        bloom = BloomFilter(held.value)
        for batch in batches:
            at = batch.schema.get_field_index
            texts = text_column(batch)
            with quiet():
                for row, line, a, b, runs, _ in _lines(texts):
                    found = np.flatnonzero(b - a >= least_words)
                    hashes = signed(runs.hashes(a[found], b[found]))
                    hit = bloom.may_hold(hashes)
                    found, hashes = found[hit], hashes[hit]
                    split: dict[int, list[str]] = {}
                    cut = []
                    for r, n in zip(row[found].tolist(), line[found].tolist()):
                        if r not in split:
                            split = {r: texts[r].as_py().split("\n")}
                        cut.append(split[r][n])
                    source = pa.array(row[found])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(at("doc_id")).take(source),
                            batch.column(at("tid")).take(source),
                            pa.array(line[found].astype(np.int32)),
                            pa.array(hashes),
                            pa.array(cut, pa.string()),
                        ],
                        ["doc_id", "tid", "line", "hash", "text"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_id().alias("tid"), "text")
    found = map_batches(source, run, f"doc_id {kind}, tid long, line int, hash long, text string")
    ids = wanted.withColumnsRenamed({"doc_id": "w_id", "tid": "w_tid", "line": "w_line", "hash": "w_hash"})
    same = (F.col("hash") == F.col("w_hash")) & (F.col("tid") == F.col("w_tid")) & (F.col("line") == F.col("w_line"))
    joined = found.join(ids, same & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return joined.select("doc_id", "tid", "line", "front", "back", "text").dropDuplicates(["doc_id", "tid", "line"])


def variants(lines: DataFrame) -> DataFrame:
    """key, kind and place (doc_id, tid, line) of the deletion neighbourhood of lines (doc_id, tid, line,
    front, back, text).

    kind 0: one word deleted, with its place; 1: the line itself; 2: one word deleted. Words of a part that
    is only known to be shared are not deleted: the edit is in the rest.
    """

    def run(batches):
        for batch in batches:
            with quiet():
                for row, _, a, b, runs, _ in _lines(text_column(batch)):
                    n = b - a
                    least = _middles(n)[1]
                    front, back = (column(batch, c).astype(bool)[row] for c in ("front", "back"))
                    begin = np.where(front & ~back, a + least, a)
                    size = np.where(back & ~front, b - least, b) - begin
                    gone = ranges(begin, size)
                    owner = np.repeat(np.arange(len(n)), size)
                    less = runs.without(a[owner], b[owner], gone)
                    placed = mix(less + PLACED + (gone - a[owner]).astype(U64) * PLACE)
                    key = np.concatenate((placed, runs.hashes(a, b), less))
                    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(less), len(n), len(less)])
                    source = pa.array(row[np.concatenate((owner, np.arange(len(n)), owner))])
                    at = batch.schema.get_field_index
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), pa.array(kind)]
                        + [batch.column(at(c)).take(source) for c in ("doc_id", "tid", "line")],
                        ["key", "kind", "doc_id", "tid", "line"],
                    )

    kind = lines.schema["doc_id"].dataType.simpleString()
    return map_batches(lines, run, f"key long, kind int, doc_id {kind}, tid long, line int")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word sequences are equal or one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    return a[front + 1 :] == b[front + (len(a) == len(b)) :] if len(a) >= len(b) else a[front:] == b[front + 1 :]


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z and the six kinds of white space only


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts = zip(batch.column(at("text")).to_pylist(), batch.column(at("other_text")).to_pylist())
            keep = [within_one(_words(x), _words(y)) for x, y in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs, run, pairs.schema)


def near_lines(docs: DataFrame, firsts: DataFrame, lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """place and ``near``, its earliest neighbour, of the first lines that have an earlier one a word away."""
    similar = written(_similar_lines(lines, least_words), "similar")
    wanted = firsts.join(similar, "hash").select("hash", "first.doc_id", "first.tid", "first.line", "front", "back")
    texts = written(_line_texts(docs, written(wanted, "wanted"), least_words), "lines")
    emitted = variants(texts).select("key", "kind", _at().alias("place"))
    # the earliest line of each key that is near all others of it, and the earliest that is near the line itself
    groups = emitted.groupBy("key").agg(
        F.min(F.when(F.col("kind") < 2, F.col("place"))).alias("line"),
        F.min(F.when(F.col("kind") == 2, F.col("place"))).alias("shortened"),
        F.max("place").alias("last"),
    )
    groups = groups.where("line IS NOT NULL AND (shortened IS NOT NULL OR line < last)")
    hub = F.when(F.col("kind") == 1, F.col("shortened")).otherwise(F.col("line"))
    pairs = emitted.join(groups, "key").withColumn("hub", hub).where("hub < place")
    pairs = pairs.select("place", "hub").distinct()
    own = texts.select(_at().alias("place"), "text")
    other = texts.select(_at().alias("hub"), F.col("text").alias("other_text"))
    checked = _verified(pairs.join(own, _same("place", own, pairs)).drop(own["place"]).join(other, "hub"))
    return checked.groupBy("place").agg(F.min("hub").alias("near"))


def _same(name: str, left: DataFrame, right: DataFrame) -> Column:
    return left[name].eqNullSafe(right[name])


def line_decisions(docs: DataFrame, least_words: int = LEAST_WORDS, edits: int = 1) -> DataFrame:
    """doc_id, tid, n_lines (with words) and ``dropped``: array of (line, first_doc_id, first_line, distance), by line.

    Lines of fewer than ``least_words`` words, and all lines if ``edits`` is 0, must be equal to be dropped.
    Documents without a line that has words are left out.
    """
    if edits not in (0, 1) or least_words < LEAST_WORDS:
        raise ValueError("edits is 0 or 1, least_words 2 or more")
    lines = written(line_rows(docs), "line-hashes")
    firsts = written(lines.groupBy(*LINE).agg(F.min(_at()).alias("first")), "first-lines")
    if edits:
        near = written(near_lines(docs, firsts, lines, least_words), "near-lines")
        # no null-safe join on a structure with a null id: the id's absence is part of the structure
        firsts = firsts.join(near, firsts["first"].eqNullSafe(near["place"]), "left").drop("place")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast(firsts.schema["first"].dataType))
    judged = lines.drop("fronts", "backs").join(firsts, LINE).withColumn("place", _at())
    again = ~F.col("place").eqNullSafe(F.col("first"))
    target = F.when(again, F.col("first")).otherwise(F.col("near"))
    decision = F.when(
        target.isNotNull(),
        F.struct(
            "line",
            target["doc_id"].alias("first_doc_id"),
            target["line"].alias("first_line"),
            F.when(again, 0).otherwise(1).alias("distance"),
        ),
    )
    # sets of one document: rows with the same id and text write the same lines, each counts once
    return judged.groupBy("doc_id", "tid").agg(
        F.size(F.collect_set("line")).cast("long").alias("n_lines"),
        F.array_sort(F.collect_set(decision)).alias("dropped"),
    )


def with_decisions(docs: DataFrame, least_words: int = LEAST_WORDS, edits: int = 1) -> DataFrame:
    """All columns of ``docs`` and ``n_lines`` and ``dropped`` (which replace columns of these names)."""
    made = line_decisions(docs, least_words, edits).select(F.col("doc_id").alias("d_id"), F.col("tid").alias("d_tid"), "n_lines", "dropped")
    docs = without(docs, "n_lines", "dropped")
    # the hash is made before the join, so that the text is shuffled only if the caller reads it
    hashed = set_aside(docs, "doc_id", "text").withColumn("own_tid", text_id())
    same = (F.col("own_tid") == F.col("d_tid")) & F.col("doc_id").eqNullSafe(F.col("d_id"))
    joined = hashed.join(made, same, "left")
    kind = made.schema["dropped"].dataType
    return joined.select(
        *brought_back(joined, docs, "doc_id", "text"),
        F.coalesce("n_lines", F.lit(0).cast(T.LongType())).alias("n_lines"),
        F.coalesce("dropped", F.array().cast(kind)).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, edits: int = 1) -> DataFrame:
    """All columns of ``docs`` with the dropped lines cut out of ``text``, and ``n_lines`` and ``dropped``."""
    judged = with_decisions(docs, least_words, edits)
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform("dropped", lambda d: d["line"]))
    text = F.array_join(F.transform(kept, lambda i: parts[i]), "\n")
    return judged.withColumn("text", F.when(F.size("dropped") > 0, text).otherwise(F.col("text")))
