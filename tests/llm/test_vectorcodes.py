from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from centsible.llm import queries, vectorcodes
from centsible.llm.vectorcodes import LARGEST_COMPONENT, LONGEST, Shape

SF = "/root/testdata/sf0.001"


def plain(vectors, shape):
    """Lloyd rounds with loops over Python numbers: (codes, errors, codebooks by part)."""
    wide = -(-len(vectors[0]) // shape.parts)
    rows = [[math.floor(shape.scale * float(x)) for x in v] + [0] * (wide * shape.parts - len(v)) for v in vectors]
    rows = [[r[p * wide : (p + 1) * wide] for p in range(shape.parts)] for r in rows]
    books = [[r[p] for r in rows[: shape.entries]] for p in range(shape.parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(shape.rounds):
        for p, book in enumerate(books):
            held = {}
            for r in rows:
                held.setdefault(assign(r[p], book)[1], []).append(r[p])
            books[p] = [[sum(c) // len(c) for c in zip(*held[k])] if k in held else book[k] for k in range(len(book))]
    found = [[assign(r[p], books[p]) for p in range(shape.parts)] for r in rows]
    return [[k for _, k in f] for f in found], [sum(e for e, _ in f) for f in found], books


def frame(spark, vectors, **more):
    rows = [(n, v, *(m[n] for m in more.values())) for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + "".join(f", {c} string" for c in more))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_rounds_with_many_ties(spark, seed):
    """Few distinct values make equal distances common; entries of equal rows stay unused."""
    rng = random.Random(seed)
    vectors = [[rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) for _ in range(8)] for _ in range(150)]
    vectors[3] = vectors[2] = vectors[0]
    shape = Shape(entries=12, rounds=5)
    rows, books = vectorcodes.compress(frame(spark, vectors).repartition(5), shape=shape)
    codes, errors, plain_books = plain([np.float32(v) for v in vectors], shape)
    got = {r.vec_id: (r.codes, r.error) for r in rows.collect()}
    assert got == {n: (codes[n], errors[n]) for n in range(len(vectors))}
    assert books.tolist() == plain_books


def test_moved_entries_alone_give_what_a_full_scan_gives():
    rng = np.random.default_rng(5)
    x = rng.integers(-4, 5, (500, 3))
    entries = rng.integers(-4, 5, (20, 3))
    index, least = vectorcodes.nearest(x, entries)
    for share in (0.0, 0.1, 0.5, 1.0):
        moved = rng.random(20) < share
        new = np.where(moved[:, None], rng.integers(-4, 5, (20, 3)), entries)
        again = vectorcodes.nearest_again(x, new, moved, index, least)
        assert [a.tolist() for a in again] == [a.tolist() for a in vectorcodes.nearest(x, new)]


def test_large_components_are_exact():
    rng = np.random.default_rng(6)
    for reach in (1 << 20, 1 << 27, 1 << 30):
        x, c = (rng.integers(-reach, reach, (n, 4)) for n in (40, 9))
        wanted = [[min(sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)), LONGEST) for v in c] for u in x]
        assert vectorcodes.distances(x, c).tolist() == wanted
    far = vectorcodes.whole_numbers(np.array([[1e30, -1e30, 3.0, -0.0005]]), Shape())
    assert far.ravel().tolist() == [LARGEST_COMPONENT, -LARGEST_COMPONENT, 3072, -1]


def test_dropped_rows_odd_widths_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [nan, 0.0, 0.0, 0.0, 0.0], [0.1, inf, 0.0, 0.0, 0.0], [0.1, None, 0.0, 0.0, 0.0]]
    vectors += [[0.5, 0.25, 0.0, 0.0, -1.0], [0.5, 0.25], [0.5, 0.25, 0.0, 0.0, 1.0], []]
    df = frame(spark, vectors, CODES=["x"] * 8, id=["i"] * 8, vector=["v"] * 8, apart=["a"] * 8)
    rows, books = vectorcodes.compress(df)
    assert rows.columns == ["vec_id", "embedding", "id", "vector", "apart", "codes", "error"]
    got = {r.vec_id: (r.codes, r.error, r.vector) for r in rows.collect()}
    # width 5 in four parts of two: the last part is fill only
    assert got == {4: ([0, 0, 0, 0], 0, "v"), 5: (None, None, "v"), 6: ([0, 0, 1, 0], 0, "v"), 7: (None, None, "v")}
    assert books.shape == (4, 2, 2)


def test_repeated_rows_and_ids_and_null_ids(spark):
    rows = [(1, [0.5] * 4)] * 3 + [(1, [0.25] * 4), (None, [0.125] * 4), (0, [0.75] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found, books = vectorcodes.compress(df, shape=Shape(entries=3, rounds=0))
    assert books[0].ravel().tolist() == [768, 256, 512]
    got = sorted((r.vec_id is None, r.vec_id, r.codes[0]) for r in found.collect())
    assert got == [(False, 0, 0), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 1, 2), (True, None, 1)]


def test_label_errors(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 5), ("a", 7), ("b", LONGEST), ("b", 9)], "label string, error long")
    got = {(r.label, r.error): r.label_error for r in vectorcodes.with_label_error(df).collect()}
    assert got == {("a", 1): 8, ("a", 7): 8, (None, 2): 7, (None, 5): 7, ("b", LONGEST): LONGEST, ("b", 9): LONGEST}


def test_empty_table(spark):
    for rows in ([], [(1, None)]):
        rows, books = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert rows.collect() == [] and books.size == 0 and vectorcodes.codebook_text(books) == ""


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    codes, errors, books = plain([np.float32(r.embedding) for r in table], Shape())
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    got = {r.vec_id: r for r in queries.op12_vector_codes(spark, SF).collect()}
    assert len(got) == len(table)
    for row, code, error in zip(table, codes, errors):
        found = got[row.vec_id]
        assert (found.code, found.error, found.codebooks_sha256) == (bytes(code).hex(), error, digest)
        assert found.label_error == sum(e for r, e in zip(table, errors) if r.label == row.label)
