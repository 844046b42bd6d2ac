"""Benchmark decontamination: test phrases are looked up in an FM-index of each training shard.

Words are lower-cased runs of digits, letters and characters beyond ASCII. Every 13 consecutive words of a benchmark item are a
phrase; an item of fewer words is one phrase. A shard is a batch of documents in a task. Its index holds
the stretches of words that a phrase could lie in: words of the benchmark whose every neighbouring pair also
occurs in a phrase, at least as long as the shortest phrase. Phrases are found by backward search
through wavelet ranks, located by sampled positions, and the words they cover are merged into spans.

The benchmark is the query set. It goes through the documents in blocks of at most ``BLOCK_BYTES`` of text; each
block is broadcast and searched in all documents, one after the other on the same rows, without a shuffle.

Words are compared by 64-bit hashes. Edge cases: null text and text without words has no words, no spans
and is not contaminated; a null or wordless item has no phrase; rows that share an item_id are one item, a null
item_id counts as ``null``; repeated rows are each searched; an empty benchmark hits nothing; an empty
table gives no rows. All columns (or those in ``keep``) are kept; the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import LOWER, WORD_BYTES, pieces, quiet, ranges, span_hashes, spans, text_column
from centsible.llm.fmindex import FmIndex
from centsible.llm.frames import map_batches, without

PHRASE = 13
BLOCK_BYTES = 16 << 20
CONTAMINATED = 20  # a document is contaminated if one word in so many is hit

SPANS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")])
)
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(data: np.ndarray, begin: np.ndarray):
    starts, ends, first = spans(WORD_BYTES[data], begin)
    return starts, ends, first, span_hashes(data, starts, ends, LOWER)


@dataclass
class Phrases:
    """The phrases of a block of items: distinct rows of word codes by length, and the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; a word's code is its place + 1
    pairs: np.ndarray  # sorted codes of neighbouring words
    single: np.ndarray  # codes of one-word phrases
    shortest: int  # length of the shortest phrase of two words or more
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # rows, begin of each row's items, items
    item_ids: list[str]

    @classmethod
    def of(cls, item_ids: list[str], texts: list[str]) -> Phrases:
        column = pa.array(texts, pa.large_string())
        hashes, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, begin in pieces(column):
            _, _, first, found = words_of(data, begin)
            hashes.append(found)
            count.append(np.diff(first))
        hashes, count = np.concatenate(hashes), np.concatenate(count)
        names = sorted(set(item_ids))
        number = {name: n for n, name in enumerate(names)}
        item = np.array([number[i] for i in item_ids], np.int64)
        vocabulary = np.unique(hashes)
        code = np.searchsorted(vocabulary, hashes) + 1
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        groups, pairs, single, lengths = [], [np.zeros(0, np.int64)], np.zeros(0, np.int64), []
        size = np.minimum(count, PHRASE)
        for length in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == length)
            places = count[own] - length + 1
            begin = ranges(first[own], places)
            rows, which = np.unique(code[begin[:, None] + np.arange(length)], axis=0, return_inverse=True)
            links = np.unique(np.column_stack((which.ravel(), np.repeat(item[own], places))), axis=0)
            groups.append((rows, np.searchsorted(links[:, 0], np.arange(len(rows) + 1)), links[:, 1]))
            if length == 1:
                single = rows[:, 0]
            else:
                lengths.append(length)
                pairs.append((rows[:, :-1] * (len(vocabulary) + 1) + rows[:, 1:]).ravel())
        return cls(vocabulary, np.unique(np.concatenate(pairs)), single, min(lengths, default=0), groups, names)


def _member(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[place] == values, place


def stretches(phrases: Phrases, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of words that can hold a phrase: codes of all words, first word and end word of each run."""
    known, place = _member(phrases.vocabulary, hashes)
    code = np.where(known, place + 1, 0)
    n = len(code)
    linked = np.zeros(n, bool)  # with the word before
    if n:
        pair = code[:-1] * (len(phrases.vocabulary) + 1) + code[1:]
        linked[1:] = known[:-1] & known[1:]
        some = np.flatnonzero(linked)
        linked[some] = _member(phrases.pairs, pair[some - 1])[0]
        linked[first[:-1][first[:-1] < n]] = False
    begin = np.flatnonzero(known & ~linked)
    after = np.ones(n, bool)
    after[:-1] = ~linked[1:]
    end = np.flatnonzero(known & after) + 1
    keep = end - begin >= phrases.shortest if phrases.shortest else np.zeros(len(begin), bool)
    if len(phrases.single):
        alone = np.concatenate(([0], np.cumsum(_member(phrases.single, code)[0])))
        keep |= alone[end] > alone[begin]
    return code, begin[keep], end[keep]


def _search(phrases: Phrases, texts: pa.Array):
    """Words of every row; merged hits (row, first word, end word, start, end); links (row, item)."""
    n_words = np.zeros(len(texts), np.int64)
    symbols, rows, word, start, stop = [], [], [], [], []
    for first_row, end_row, data, begin in pieces(texts):
        starts, ends, first, hashes = words_of(data, begin)
        n_words[first_row:end_row] = np.diff(first)
        code, run_first, run_end = stretches(phrases, hashes, first)
        if not len(run_first):
            continue
        size = run_end - run_first
        at = ranges(run_first, size)
        row = np.searchsorted(first, at, "right") - 1
        # where the words lie in their text, in code points
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        closed = np.cumsum(size)  # a 0 after each run
        for kept, values in (
            (symbols, code[at]),
            (rows, row + first_row),
            (word, at - first[row]),
            (start, points[starts[at]] - points[begin[row]]),
            (stop, points[ends[at]] - points[begin[row]]),
        ):
            kept.append(np.insert(values, closed, 0))
    none = np.zeros(0, np.int64)
    if not symbols:
        return n_words, (none,) * 5, (none, none)
    symbols, rows, word, start, stop = (np.concatenate(x) for x in (symbols, rows, word, start, stop))
    index = FmIndex(symbols, len(phrases.vocabulary))
    edge = np.zeros(len(symbols) + 1, np.int64)
    links = []
    for patterns, item_begin, items in phrases.groups:
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        which, position = index.locate(low[found], high[found])
        np.add.at(edge, position, 1)
        np.add.at(edge, position + patterns.shape[1], -1)
        seen = np.unique(np.column_stack((rows[position], found[which])), axis=0)
        count = item_begin[seen[:, 1] + 1] - item_begin[seen[:, 1]]
        links.append(np.column_stack((np.repeat(seen[:, 0], count), items[ranges(item_begin[seen[:, 1]], count)])))
    hit = np.cumsum(edge[:-1]) > 0
    opens = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    closes = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
    merged = (rows[opens], word[opens], word[closes] + 1, start[opens], stop[closes])
    links = np.unique(np.concatenate(links), axis=0)
    return n_words, merged, (links[:, 0], links[:, 1])


def _merge(old: list, new: list) -> list:
    """Union of two sorted lists of (first_word, end_word, start, end)."""
    if not old or not new:
        return old or new
    out: list = []
    for span in sorted(old + new):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1] = (out[-1][0], span[1], out[-1][2], span[3])
        else:
            out.append(span)
    return out


def _batches(phrases: Phrases, kept: list[str], more: bool, batches) -> Iterator[pa.RecordBatch]:
    """``more``: the rows went through another block already."""
    for batch in batches:
        texts = text_column(batch)
        with quiet():
            n_words, merged, (link_row, link_item) = _search(phrases, texts)
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for row, *span in zip(*(m.tolist() for m in merged)):
            found[row].append(tuple(span))
        # neighbouring runs of a text can touch
        found = [_merge([], s) if len(s) < 2 else _merge(s[:1], s[1:]) for s in found]
        items: list[set] = [set() for _ in range(batch.num_rows)]
        for row, item in zip(link_row.tolist(), link_item.tolist()):
            items[row].add(phrases.item_ids[item])
        if more:
            at = batch.schema.get_field_index
            before = batch.column(at("spans")).to_pylist()
            found = [_merge([tuple(s.values()) for s in b], f) for b, f in zip(before, found)]
            items = [set(b) | i for b, i in zip(batch.column(at("items")).to_pylist(), items)]
        names = [f.name for f in SPANS.elementType.fields]
        span_type = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        columns = [
            pa.array(n_words),
            pa.array([[dict(zip(names, s)) for s in f] for f in found], span_type),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], [*kept, *(f.name for f in ADDED)]
        )


def blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The items in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").where("text IS NOT NULL")
    ids, texts, size = [], [], 0
    for item_id, text in rows.toLocalIterator():
        if texts and size + len(text) > BLOCK_BYTES:
            yield Phrases.of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    with quiet():
        yield Phrases.of(ids, texts)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` and ``n_words``, ``spans`` (merged, in words and in code points) and ``items``
    (ids of the items with a phrase in the text, sorted)."""
    docs = without(docs, *(f.name for f in ADDED))
    kept = docs.columns if keep is None else keep
    context, found = docs.sparkSession.sparkContext, docs
    passes = [context.broadcast(block) for block in blocks(benchmark)]  # each of a bounded size
    for n, held in enumerate(passes):
        columns = kept if n == len(passes) - 1 else docs.columns

        def run(batches, held=held, columns=columns, more=n > 0):
            return _batches(held.value, columns, more, batches)

        found = map_batches(found, run, T.StructType([*(docs.schema[c] for c in columns), *ADDED]))
    return found


def n_hit(spans_column: Column) -> Column:
    """Words covered by the spans."""
    return F.aggregate(spans_column, F.lit(0).cast("long"), lambda s, x: s + x["end_word"] - x["first_word"])


def is_contaminated(hits: Column, words: Column) -> Column:
    return (hits > 0) & (F.lit(CONTAMINATED) * hits >= words)
