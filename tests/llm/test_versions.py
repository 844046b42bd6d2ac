from __future__ import annotations

import random

import pytest

from centsible.llm import fingerprints as fp
from tests.llm.test_fingerprints import sets


def signed(digests):
    return sorted(d - (1 << 64) if d >= 1 << 63 else d for d in digests)


def versions():
    rng = random.Random(3)
    words = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (1, 40, 3000, 6000)]
    old = {n: " ".join(w) for n, w in enumerate(words)} | {10: "as it was", 11: None, 12: "gone", None: "no id " * 9}
    new = {n: " ".join(w if rng.random() > 0.1 else "new" for w in part) for n, part in enumerate(words)}
    return old, new | {10: "as it was", 11: "now a text", 13: "come", None: "no id"}


@pytest.mark.parametrize("cells", [None, 4])
def test_every_digest_of_either_side(spark, cells):
    old, new = versions()
    kind = "doc_id long, text string"
    found = fp.version_differences(*(spark.createDataFrame(list(v.items()), kind) for v in (old, new)), cells).collect()
    ids = set(old) | set(new)
    assert len(found) == len(ids)
    for r in found:
        (a, b), _ = sets([old.get(r.doc_id), new.get(r.doc_id)])
        assert (r.removed, r.added) == (signed(a - b), signed(b - a))


def test_stored_sketches_that_are_too_small_say_so(spark):
    old, new = (spark.createDataFrame(list(v.items()), "doc_id long, text string") for v in versions())
    got = {r.doc_id: r.emptied for r in fp.subtracted(fp.sketches(old, 4), fp.sketches(new, 4)).collect()}
    assert got[10] and not got[3]


def test_repeated_ids_are_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fp.version_differences(docs, docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a line\nand another"), (2, None)], "doc_id long, text string")
    assert fp.version_differences(none, none).count() == 0
    got = {r.doc_id: (len(r.removed), len(r.added)) for r in fp.version_differences(none, some).collect()}
    assert got[1][0] == 0 and got[1][1] > 0 and got[2] == (0, 0)
