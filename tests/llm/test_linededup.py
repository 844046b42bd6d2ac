from __future__ import annotations

import itertools
import random

import pytest

from centsible.llm import linededup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_apart(a, b):
    # one edit changes the length by one at most and the set of words by two
    return abs(len(a) - len(b)) <= 1 and len(set(a) ^ set(b)) <= 2 and distance(a, b) <= 1


def by_hand(rows, least=2, edits=1):
    """{(doc_id, text): (n_lines, dropped)} by comparing every line with all earlier ones."""
    docs = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    earlier, out = [], {}
    for _, doc_id, text in docs:
        dropped, n_lines = [], 0
        for line, part in enumerate(text.split("\n")):
            words = tuple(ld._words(part))
            if not words:
                continue
            n_lines += 1
            same = next((e for e in earlier if e[0] == words), None)
            near = None
            if len(words) >= least and edits and not same:
                near = next((e for e in earlier if len(e[0]) >= least and one_apart(e[0], words)), None)
            if found := same or near:
                dropped.append((line, found[1], found[2], 0 if same else 1))
            earlier.append((words, doc_id, line))
        out[doc_id, text] = (n_lines, dropped)
    return out


def check(spark, rows, *limits):
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, line string, hash string")
    want = by_hand(rows, *limits)
    got = ld.with_decisions(docs, *limits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, [tuple(d) for d in r.dropped]) == want[r.doc_id, r.text or ""], r.text
    return docs


WORDS = "the of and in to a is it on as by at".split()


def line(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(3)) for _ in range(n)]


@pytest.mark.parametrize("limits", [(2, 1), (8, 1), (5, 1), (2, 0)])
def test_random_edits(spark, limits):
    rng = random.Random(4)
    lines = [line(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 30])) for _ in range(40)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            words = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                if kind == 0:
                    words[at] = "new" + str(rng.randrange(4))
                elif kind == 1:
                    words.insert(at, "more")
                elif len(words) > 1:
                    del words[at]
            parts.append(rng.choice([" ", "  ", "\t"]).join(words).title())
        rows.append((doc, rng.choice(["\n", "\n\n", "\r\n"]).join(parts)))
    check(spark, rows, *limits)


def test_tiny_lines(spark):
    """Every pair of lines of up to five words of two kinds, and which are one word apart."""
    kinds = [words for n in range(1, 6) for words in itertools.product("ab", repeat=n)]
    random.Random(3).shuffle(kinds)
    check(spark, [(n, " ".join(words)) for n, words in enumerate(kinds)])


def test_limits_that_make_no_sense(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for limits in ((1, 1), (2, 2)):
        with pytest.raises(ValueError):
            ld.line_decisions(docs, *limits)


def test_repeated_words_and_chains(spark):
    a = "a a a a a a a a"
    rows = [(3, a + " a"), (1, a), (2, a + " a a"), (9, "b " + a), (8, "1 2 3 4 5 6 7"), (7, "1 2 3 4 5 6 7"), (6, "1 2 3 4 5 6 8")]
    check(spark, rows)


def test_nulls_repeats_blank_and_long(spark):
    long = "\n".join(["same line of words that is repeated very often here"] * 3000 + ["y" * 60_000])
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, long), (4, long), (None, "same line of words that is repeated very often there"), (None, None), (0, "É\né\n\n")]
    docs = check(spark, rows)
    texts = {(r.doc_id, r.n_lines): r.text for r in ld.dedup_lines(docs).collect()}
    assert texts[4, 3001] == "same line of words that is repeated very often here\n" + "y" * 60_000
    assert texts[None, 1] == "" and texts[1, 0] is None and texts[3, 0] == " \n\t\n" and texts[0, 2] == "É\né\n\n"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.with_decisions(empty).count() == 0 and ld.dedup_lines(empty).count() == 0


def test_within_one():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("ab") for _ in range(rng.randrange(7))]
        b = [rng.choice("ab") for _ in range(rng.randrange(7))]
        assert ld.within_one(a, b) == (distance(a, b) <= 1)
