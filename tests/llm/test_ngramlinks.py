from __future__ import annotations

import random

import pytest

from centsible.llm import ngramjoin, queries
from tests.llm.test_ngramjoin import edited, shingle_set


def links_by_hand(rows):
    """[(doc_id, n_shingles, n_links)] by comparing all pairs."""
    sets, count = [shingle_set(t) for _, t in rows], [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                count[i] += 1
                count[j] += 1
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, count)]


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cls int, n int").repartition(parts)
    got = sorted(((r.doc_id, r.n_shingles, r.n_links) for r in ngramjoin.link_counts(docs).collect()), key=str)
    assert got == sorted(links_by_hand(rows), key=str)
    return docs


def test_links_within_a_group_of_near_copies(spark, monkeypatch):
    """Different texts that all hang together by a hub are linked with each other too, in small blocks and batches."""
    monkeypatch.setattr(ngramjoin, "AT_ONCE", 50)
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    rng = random.Random(4)
    texts = []
    for size in (4, 8, 30, 200):
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))) for _ in range(40)]
    rows = list(enumerate(texts))
    docs = check(spark, rows)

    members, links = ngramjoin.class_links(docs)
    cls = {r.doc_id: r.cls for r in members.collect()}
    pairs = sorted((r.u, r.v) for r in links.collect())
    sets = {cls[d]: shingle_set(t) for d, t in rows}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert pairs == sorted((u, v) for u in sets for v in sets if u < v and sets[u] and alike(sets[u], sets[v]))


def test_copies_nulls_and_empty_tables(spark):
    check(spark, [(5, None), (6, ""), (3, "One two"), (2, "one  TWO"), (2, "one  TWO"), (None, "one two"), (9, "alone here")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.link_counts(empty).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op1_ngram_links(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted(links_by_hand(rows))


def test_long_texts(spark):
    words = [f"w{n % 977}x{n}" for n in range(30_000)]
    other = words[:15_000] + ["new"] * 40 + words[15_040:]
    check(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:20_000])), (4, "y" * 500_000)])
