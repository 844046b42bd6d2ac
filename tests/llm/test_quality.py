from __future__ import annotations

import zlib

import numpy as np

from centsible.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, SF).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = ([s for s, q in judged if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.3) == q for s, q in judged]) > 0.97


def test_score_depends_on_text_only(spark):
    docs = spark.createDataFrame(
        [(1, "The one and the other.", "a", 1), (2, "The one and the other.", "b", 2), (3, None, "a", 3), (3, "", "b", 3)],
        "doc_id long, text string, lang string, quality int",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (7, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == 1.0  # one learnable label
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert got[0].score == got[1].score > got[2].score == got[3].score
    assert [r.n_passages for r in got] == [1] * 4 and got[0].quality == 1


def test_no_labels_empty_table_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model == 0.5 and quality.score(docs, model).count() == 0
    clash = spark.createDataFrame([(1, "a", 0.1)], "doc_id long, text string, score double")
    assert quality.score(clash, model).first().score == 0.5


def test_every_passage_counts():
    import pyarrow as pa

    words = " ".join(f"w{n}" for n in range(1000))
    (found,) = list(quality.passage_features(pa.array([words, "", " ", "a b", None])))
    features, opens = found
    assert np.diff(opens).tolist() == [8, 1, 1, 1, 1] and len(features) == 12
    assert features[8].tolist() == features[11].tolist()


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    x, opens, label = rng.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    w = {"encode": (5, 4), "encode_0": (4,), "signal": (4, 3), "gate": (4, 3), "attend": (3,), "score": (4,), "score_0": (1,)}
    w = {k: rng.normal(size=s) for k, s in w.items()}

    def loss():
        p = quality._forward(w, x, opens)["score"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, grad in quality._gradients(w, x, opens, label).items():
        at = (0,) * w[name].ndim
        keep = w[name][at]
        w[name][at] = keep + 1e-6
        up = loss()
        w[name][at] = keep - 1e-6
        down = loss()
        w[name][at] = keep
        assert abs((up - down) / 2e-6 - grad[at]) < 1e-6, name


def test_all_passages_of_the_sample_are_learned(spark):
    """What marks a bad document stands in one far passage; thinned texts would hide it."""
    good = " ".join(f"word{n % 50}" for n in range(128 * 40))
    at = 128 * 37
    bad = good.split()
    bad[at : at + 128] = ["$$$"] * 128
    rows = [(n, good if n % 2 else " ".join(bad)) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, quality int")
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all(r.n_passages == 40 and (r.score >= 0.5) == r.doc_id % 2 for r in found)
    assert {r.top_passage for r in found if r.doc_id % 2 == 0} == {37}


def test_bounds_of_the_sample(spark):
    """One row per id however often it is repeated; whole documents as long as their passages have room."""
    rows = [(1, "a b " * 20)] * 500 + [(2, "$ " * 128 * 9)] + [(3, "c d"), (4, "$ %")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    seen = []
    keep, quality.fit_bags = quality.fit_bags, lambda x, opens, label, seed=7: seen.append((np.diff(opens).tolist(), label.tolist()))
    try:
        quality.fit(docs, labels)
        quality.fit(docs, labels, max_passages=5)
    finally:
        quality.fit_bags = keep
    assert seen == [([1, 9, 1, 1], [1.0, 0.0, 1.0, 0.0]), ([1, 1, 1], [1.0, 1.0, 0.0])]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 100_000), (2, "x" * 2_000_000), (3, "dolor")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    got = {r.doc_id: r.n_passages for r in quality.score(docs, model).collect()}
    assert got == {1: 1563, 2: 1, 3: 1}
