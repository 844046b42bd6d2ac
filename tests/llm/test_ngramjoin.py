from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from centsible.llm import graph, ngramjoin, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def by_hand(rows):
    """[(doc_id, n_shingles, component_id)] by counting the overlaps of all pairs."""
    sets, lists, parent = [shingle_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cls int, n int").repartition(parts)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.shingle_components(docs).collect()), key=str)
    assert got == sorted(by_hand(rows), key=str)
    return docs


def edited(rng, words, share):
    out = []
    for w in words:
        kind = rng.random() / share if share else 9
        if kind < 0.4:
            out.append(f"new{rng.randrange(10**6)}")
        elif kind < 0.7:
            out += [w, "more"]
        elif kind >= 1:
            out.append(w)
    return out


def test_near_copies_of_all_degrees(spark):
    """Edits around the threshold, chains of copies of copies, a hot group and a passage that many share."""
    rng = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for size in (3, 6, 9, 12, 30, 80, 300):
        base = [rng.choice(words) for _ in range(size)]
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06):
            texts += [edited(rng, base, share) for _ in range(3)]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 0.02)
            texts.append(chain)
    texts += [edited(rng, passage * 2, 0.01) for _ in range(80)]
    texts += [passage + [rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(60)]
    texts += [["the", "of", "and", "in", "to", rng.choice(words)] for _ in range(30)]
    rng.shuffle(texts)
    check(spark, [(n, " ".join(t)) for n, t in enumerate(texts)], parts=5)


def test_every_turn_is_taken(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FIRST_TURN", 5)
    monkeypatch.setattr(ngramjoin, "GROWTH", 3)
    monkeypatch.setattr(ngramjoin, "AT_ONCE", 7)
    monkeypatch.setattr(ngramjoin, "BLOCK", 3)
    monkeypatch.setattr(ngramjoin, "COUNTED_TOGETHER", 200)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 20)
    rng = random.Random(8)
    base = [f"w{n}" for n in range(60)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03]))) for _ in range(60)]
    check(spark, list(enumerate(texts)))


def test_nulls_repeats_and_long(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (3, "One two"), (2, "one  TWO"), (2, "one  TWO"), (None, "one two")]
    rows += [(None, "alone here"), (9, "É é"), (8, "é é"), (20, "word " * 30_000), (21, "word " * 20), (22, "x" * 100_000)]
    docs = check(spark, rows)
    stay = sorted(((r.doc_id, r.text) for r in ngramjoin.one_per_component(docs).collect()), key=str)
    gone = {(3, "One two"), (21, "word " * 20)}
    assert stay == sorted((r for r in rows if r not in gone), key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.shingle_components(empty).count() == 0 and ngramjoin.one_per_component(empty).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op1_ngram_join(spark, sf).collect())
    assert got == sorted(by_hand(rows))


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n_ids = int(rng.integers(1, 30))
        lists = [np.unique(rng.integers(0, n_ids, rng.integers(1, 3 * n_ids))).tolist() for _ in range(rng.integers(1, 40))]
        count = Counter(i for part in lists for i in part)
        needed = rng.integers(1, len(lists) + 2, n_ids).tolist()
        assert sorted(ngramjoin.divide_skip(lists, needed)) == [i for i in range(n_ids) if count[i] >= needed[i]]


def test_overlap_needed():
    for n in range(1, 60):
        for m in range(1, 60):
            need = ngramjoin.overlap_needed(n, m)
            assert ngramjoin.linked(need, n, m) and not ngramjoin.linked(need - 1, n, m)


def test_linked_sets_share_the_needed_lists():
    """Against random sets under random orders, also with the smallest overlap that links."""
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(1, 120)
        m = rng.randrange(max(1, -(-4 * n // 5)), n * 5 // 4 + 1)
        least = ngramjoin.overlap_needed(n, m)
        if least > min(n, m):
            continue
        common = rng.randrange(least, min(n, m) + 1)
        keys = rng.sample(range(10**6), n + m - common)
        a, b = set(keys[:n]), set(keys[n - common :])
        shared, *ends = ngramjoin.shared_prefixes(np.int64(len(a)), np.int64(len(b)))
        assert all(end <= ngramjoin.listed(np.int64(len(s))) for s, end in zip((a, b), ends))
        first = [set(sorted(s)[: int(end)]) for s, end in zip((a, b), ends)]
        assert len(first[0] & first[1]) >= shared


def test_components(spark):
    rng = random.Random(6)
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_forest_roots(spark):
    """A chain of two hundred nodes, a star and a pair."""
    rows = [(n, n - 1) for n in range(1, 200)] + [(n, 1000) for n in range(1001, 1050)] + [(3000, 2000)]
    got = {r.node: r.root for r in graph.forest_roots(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {n: 0 for n in range(200)} | {n: 1000 for n in range(1000, 1050)} | {2000: 2000, 3000: 2000}


def test_names_that_clash(spark):
    columns = ["doc_id", "text", "cls", "n", "hub", "root", "rid", "key", "place", "block"]
    rows = [(i, t, *(["x"] * 8)) for i, t in [(1, "one two three four five six"), (2, "One two three four five six"), (3, None)]]
    docs = spark.createDataFrame(rows, columns)
    got = sorted((r.doc_id, r.component_id) for r in ngramjoin.shingle_components(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in ngramjoin.one_per_component(docs).collect()) == [1, 3]


def test_pairs_listed_follow_the_links(spark):
    """Versions of a text that are mostly too far apart: hardly a pair is listed that is not linked."""
    rng = random.Random(12)
    base = [f"w{n}" for n in range(90)]
    rows = [(n, " ".join(edited(rng, base, 0.06))) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, classes, lists = ngramjoin._classes(docs)
    wanted, _, table_name = ngramjoin._listed(docs, classes, lists)
    every = lists.selectExpr("key", "cls", "n", "place", "cls AS root")
    listed = ngramjoin._further_pairs(every, wanted, 0, 1.0).count()
    spark.sql(f"DROP TABLE {table_name}")
    sets = [shingle_set(t) for _, t in rows]
    n_linked = sum(100 * len(a & b) >= 80 * len(a | b) for n, a in enumerate(sets) for b in sets[:n])
    assert n_linked <= listed <= 1.1 * n_linked + 10


def test_sketches_never_lose_a_link():
    """Sets at the threshold, of sizes below and above the bits of a sketch."""
    rng = np.random.default_rng(5)
    for _ in range(500):
        n, m = (int(x) for x in rng.integers(1, rng.choice([40, 3000]), 2))
        common = min(n, m, ngramjoin.overlap_needed(n, m))
        keys = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        both = np.concatenate((keys[:n], keys[n - common :]))
        left, right = ngramjoin.sketches(both, np.array([0, n, n + m]))
        linked = ngramjoin.linked(common, n, m)
        assert not linked or ngramjoin.may_link(left[:, None], right[:, None], np.array([n]), np.array([m]))[0]
    assert ngramjoin.sketches(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * len(ngramjoin.SKETCH)]
