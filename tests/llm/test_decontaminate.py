from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from centsible.llm import decontaminate as dc
from centsible.llm import fmindex, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, items):
    """(n_words, n_hit, item ids) by trying every phrase at every place."""
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        phrases = words(item)
        size = min(13, len(phrases))
        places = {}
        for n in range(len(w) - size + 1):
            places.setdefault(tuple(w[n : n + size]), []).append(n)
        for n in range(len(phrases) - size + 1 if size else 0):
            for at in places.get(tuple(phrases[n : n + size]), []):
                hit.update(range(at, at + size))
                found.add("null" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = queries.op2_decontaminate(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n_words, n_hit, found = by_hand(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n_words, n_hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (10, "Short Item é"),
    (2, "x"),
    (3, None),
    (4, "... !"),
    (5, "one"),
    (2, "y z"),
    (None, "la la la"),
    (7, "la la"),
]
TEXTS = [
    "zero one TWO three,four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen",
    "two three four five six seven eight nine ten eleven twelve thirteen",
    "short item é short item e Short-Item\té",
    "la " * 300,
    "x y z x",
    "one",
    " é ",
    "",
    None,
    "q" * 100_000,
    ("one two three four five six seven eight nine ten eleven twelve thirteen " * 3).strip(),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_phrases_of_all_lengths_and_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(n % 9, t, "kept", 1) for n, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string, item_id string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = dc.find_contamination(docs, bench).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        got = (r.n_words, sum(s.end_word - s.first_word for s in r.spans), r.items)
        assert got == by_hand(r.text, ITEMS) and r.item_id == "kept"
        assert all(a.end_word < b.first_word for a, b in zip(r.spans, r.spans[1:]))
        for s in r.spans:
            assert words(r.text[s.start : s.end]) == words(r.text)[s.first_word : s.end_word]


def test_empty_tables_and_clash(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = dc.find_contamination(docs, none).collect()
    assert (row.n_words, row.spans, row.items) == (3, [], [])
    assert dc.find_contamination(docs.limit(0), none).count() == 0
    assert dc.find_contamination(docs.selectExpr("*", "1 AS spans"), none).first().spans == []


def test_index_against_plain_search():
    rng = np.random.default_rng(5)
    for largest, runs, top in ((1, 4, 60), (3, 20, 30), (50, 200, 12), (5, 1, 1)):
        text = np.concatenate([np.append(rng.integers(1, largest + 1, rng.integers(1, top + 1)), 0) for _ in range(runs)])
        order = fmindex.suffix_order(text)
        ends = np.flatnonzero(text == 0)
        whole = lambda p: [*(text[p : ends[np.searchsorted(ends, p)]] + len(text)).tolist(), int(ends[np.searchsorted(ends, p)]) - len(text)]  # noqa: B023, E731
        assert order.tolist() == sorted(range(len(text)), key=whole)
        index = fmindex.FmIndex(text, largest)
        for size in (1, 2, 4):
            patterns = np.unique(rng.integers(1, largest + 1, (30, size)), axis=0)
            low, high = index.search(patterns)
            which, position = index.locate(low, high)
            got = sorted(zip(which.tolist(), position.tolist()))
            want = [(k, p) for k, row in enumerate(patterns.tolist()) for p in range(len(text)) if text[p : p + size].tolist() == row]
            assert got == sorted(want)
