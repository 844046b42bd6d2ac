from __future__ import annotations

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from centsible.llm import bpe, queries, settings

SF = "/root/testdata/sf0.001"
PATH = settings.VOCABULARY
TEXTS = [
    "Hello world's café ΑΣ ﬁ <|endoftext|> a",
    "<|startoftext|><|endoftext|>x<|end <",
    "12 3a!! don't I'Ve 'LL",
    "İstanbul ÀÉ é x\x1cy\x85z\x00",
    "日本語 ☃️ १२३ ²½ Ⅷ ǅ ß ẞ é‍ ΣΑΣ. Σ",
    "a" * 5000 + " " + "the" * 400 + "!" * 900,
    " \n\t ",
    "",
    None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return bpe.Bpe(json.loads(bpe.read_spec(PATH)))


def test_frames_equal_library(spark, library):
    rows = [(n, t, "kept") for n, t in enumerate(TEXTS + TEXTS[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_by string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(got) == len(rows)
    for n, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[n].ids == ids and got[n].n_tokens == len(ids) and got[n].decoded_by == "kept"
        assert got[n].decoded == library.decode(ids, skip_special_tokens=False)


def test_random_words_both_ways(mine, library):
    rng = random.Random(3)
    letters = "etaoinshrdlu" * 3 + "qzxéßñ日'!1 "
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for n in (2, 7, 40, 150):
        parts = [rng.choice(mine.first_ids[97:123]) for _ in range(n)]
        assert mine._scan(list(parts)) == mine._heap(list(parts))


def test_cache_is_bounded(mine, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    small = bpe.WordCache(mine.encode_word)
    for n in range(100):
        assert small[f"word{n}"] == mine.encode_word(f"word{n}")
        assert len(small) <= 10


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH).count() == 0
    both = bpe.encode(spark.createDataFrame([(1, "Hi there"), (2, None)], "doc_id long, text string"), PATH, "again")
    assert [(r.again, r.n_tokens) for r in both.collect()] == [("hi</w> there</w>", 2), ("", 0)]
    clash = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, IDS int")
    assert bpe.encode(clash, PATH).columns == ["doc_id", "text", "ids", "n_tokens"]


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_repeated_rows(spark, library):
    docs = spark.createDataFrame([(1, "Same text, twice"), (1, "Same text, twice"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in settings.token_digests(docs).collect())
    n = len(library.encode("Same text, twice", add_special_tokens=False).ids)
    assert got == [(1, n), (1, n), (2, 0), (2, 0)]
