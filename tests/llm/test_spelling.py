from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from centsible.llm import spelling

WORDS = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, slips=True):
    found = Counter()
    for doc_id, text in rows:
        for run in WORDS.findall(text or ""):
            word = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slips and h % spelling.SLIP == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                found[word] += 1
    return found


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if n >= 3}
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if is_near(w, v)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 2 * n else None
        out[w] = (n, len(near), form, words.get(form))
    rooted = {}
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rooted[w] = (n, k, form, form_n, root)
    return rooted


def variants(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = spelling.spelling_variants(docs).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


def mutated(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.fixture
def short_limit(monkeypatch):
    """Words over seven characters take the way of long ones."""
    monkeypatch.setattr(spelling, "LONG", 7)


def corpus(seed, letters="abéÉ"):
    """Few letters, so that runs of equal ones and words with many neighbours are common."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 11))) for _ in range(60)]
    words += [mutated(rng, rng.choice(words), letters) for _ in range(200)]
    rows = [(n, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60))) for n in range(60)]
    return rows + [(None, "aaaaa AAAAA aaaaa, bbbbb"), (5, None), (6, ""), (7, "12 3_4 $")]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    assert variants(spark, rows) == plain_variants(plain_counts(rows))


def test_long_words_like_all_pairs(spark, short_limit):
    rows = corpus(3)
    assert variants(spark, rows) == plain_variants(plain_counts(rows))


def test_words_around_the_long_limit(spark):
    base = "".join(random.Random(4).choice("abcdefgh") for _ in range(spelling.LONG + 3))
    words = [base[: spelling.LONG + k] for k in range(-2, 4)] + ["x" + base[1 : spelling.LONG], base[:-1] + "ÿ"]
    rows = [(n, " ".join(w for k, w in enumerate(words) for _ in range(k + 1))) for n in range(3)]
    got = variants(spark, rows)
    assert got == plain_variants(plain_counts(rows))
    assert len(got) == len(words)


def test_very_long_runs_and_texts(spark):
    rows = [(n, "q" * 3000 + ("r" if n else "") + " " + "word " * 50_000) for n in range(6)] * 2
    got = variants(spark, rows)
    assert got == plain_variants(plain_counts(rows))
    assert got["q" * 3000 + "r"][1] == 0  # the shorter one occurs twice only


def test_chain_of_forms_ends_at_its_root(spark):
    words = {"aaaaaaa": 3, "aaaaaab": 6, "aaaaabb": 12, "aaaabbb": 24, "aaabbbb": 48, "aabbbbb": 96}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    got = variants(spark, rows)
    assert got == plain_variants(plain_counts(rows))
    assert len({v[4] for w, v in got.items()}) <= 2


def test_checksums_of_runs():
    rng = random.Random(7)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 47, 48, 49, 300]))) for _ in range(200)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(b"%d:" % n) for n in range(200)], np.uint32)
    got = spelling.crc32_of_runs(data, np.concatenate(([0], ends[:-1])), ends, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % n + w) for n, w in enumerate(words)]


def test_counts_of_hot_words_with_few_held(spark, monkeypatch):
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    for slips in (True, False):
        got = {r.word: r.n for r in spelling.count_words(docs, slips).collect()}
        assert got == dict(plain_counts(rows, slips))


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "alpha " * 9, "w", 3)], "doc_id long, text string, word string, n int")
    assert [tuple(r) for r in spelling.spelling_variants(docs).collect()] == [("alpha", 9, 0, None, None, "alpha")]
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
