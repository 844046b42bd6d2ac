from __future__ import annotations

import zlib

import numpy as np
import pytest

from centsible.llm import langid, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id][0] for r in rows if r.held_out]) > 0.99


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.fit(docs)


def test_counts_equal_plain_counts(spark):
    texts = [("x", "ab Abc"), ("x", "ab"), ("y", "é"), (None, "zz"), ("y", None)]
    learned = langid.fit(spark.createDataFrame(texts, "lang string, text string"))
    assert learned.languages == ["x", "y"]
    # ' ab ', ' abc', 'abc ', ' ab ' and ' é ' (two bytes)
    rest = langid.SMOOTHING / (4 + langid.SMOOTHING * langid.BUCKETS)
    seen = np.exp(learned.table[0].astype(float)) / rest
    assert sorted(np.round(seen[seen > 1.5] * langid.SMOOTHING - langid.SMOOTHING, 2).tolist()) == [1.0, 1.0, 2.0]
    assert (learned.table[1] > learned.table[1].min() + 0.1).sum() == 1


def test_mixed_document(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 3000").collect()}
    mixed = docs["en"][:2000] + "\n" + docs["de"][:1000]
    (row,) = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert set(row.shares) == {"en", "de"} and row.lang_pred == "en" and 0.5 < row.score < 0.8


def test_undetermined_and_clash(spark, model):
    texts = [None, "", "123 !!", " ", "²", "the", "日本", "the"]
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = [(r.lang_pred, r.score > 0) for r in langid.predict(docs, model).orderBy("doc_id").collect()]
    assert got[:5] == [("und", False)] * 5 and all(lang != "und" and s for lang, s in got[5:])
    assert got[5] == got[7]
    assert langid.predict(docs.withColumn("shares", docs.text), model).first().shares == {}


def test_nothing_to_learn_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.fit(empty)
    assert nothing.languages == [] and langid.predict(empty, nothing).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(one, nothing).collect()] == ["und"]


def plain_em(likely, active):
    """Shares and log likelihood of one document by loops; likely[word][language]."""
    share = [1 / sum(active) if a else 0.0 for a in active]
    for _ in range(langid.ROUNDS):
        total = [0.0] * len(active)
        for word in likely:
            parts = [p * s for p, s in zip(word, share)]
            for k, part in enumerate(parts):
                total[k] += part / max(sum(parts), 1e-30)
        share = [t / len(likely) if a else 0.0 for t, a in zip(total, active)]
        share = [s / max(sum(share), 1e-30) for s in share]
    return share, sum(np.log(max(sum(p * s for p, s in zip(word, share)), 1e-30)) for word in likely)


def plain_mixture(table, words):
    """words: lists of buckets of one document."""
    if not words:
        return [0.0] * len(table)
    logs = [[sum(float(one[b]) for b in word) * langid.EVIDENCE for one in table] for word in words]
    likely = [[np.exp(v - max(word)) for v in word] for word in logs]
    active = [True] * len(table)
    share, fit = plain_em(likely, active)
    while sum(active) > 1:
        inside = [k for k, a in enumerate(active) if a]
        least = min(inside, key=lambda k: share[k])
        fewer = [a and share[k] >= 0.01 / len(words) and k != least for k, a in enumerate(active)]
        new_share, new_fit = plain_em(likely, fewer)
        gone = sum(active) - sum(fewer)
        if -2 * new_fit - langid.PENALTY * gone * np.log(len(words) + 1) > -2 * fit:
            break
        active, share, fit = fewer, new_share, new_fit
    return share


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.ones(40) * 0.3, 4) + 1e-4).astype(np.float32)
    docs = []
    for _ in range(30):
        langs = rng.choice(4, rng.integers(1, 4), replace=False)
        words = []
        for _ in range(int(rng.integers(0, 40))):
            share = np.exp(table[rng.choice(langs)].astype(float))
            words.append(rng.choice(40, int(rng.integers(1, 6)), p=share / share.sum()).tolist())
        docs.append(words)
    flat = [word for words in docs for word in words]
    opens = np.concatenate(([0], np.cumsum([len(w) for w in flat])))
    first = np.concatenate(([0], np.cumsum([len(words) for words in docs])))
    got = langid.mixtures(table, np.concatenate([np.array(w) for w in flat]), opens, first)
    wanted = np.array([plain_mixture(table, words) for words in docs])
    assert np.abs(got - wanted).max() < 1e-3
    assert ((got > 0) == (wanted > 0)).all() and 0 < (got > 0).sum() < got.size


def test_very_long_text(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 3000").collect()}
    long = spark.createDataFrame([(1, docs["de"] * 300), (2, "x" * 1_500_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(long, model).collect()}
    assert got[1] == "de" and got[2] in model.languages
