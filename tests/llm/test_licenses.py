from __future__ import annotations

import random
import re

from centsible.llm import licenses, queries
from centsible.llm.licenses import NOTICES, PHRASES, Notice, Searcher, normal

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_edits(pattern, text):
    """The least edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for char in text:
        before, row[0] = row[0], 0
        for i, wanted in enumerate(pattern, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (wanted != char))
        best = min(best, row[-1])
    return best


def mutated(rng, text, edits, letters="abc éxyz"):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice(letters) + text[i:], text[:i] + rng.choice(letters) + text[i + 1 :]])
    return text


def plain_base(text):
    """(words, sorted (first word, label)) of the phrases."""
    words = WORDS.findall((text or "").translate(SMALL))
    found = []
    for notice in PHRASES:
        wanted = notice.text.split()
        found += [(i, notice.label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    return words, sorted(found)


def test_each_notice_alone_like_edit_distance():
    """One searcher per notice, so that no other notice takes the place."""
    rng = random.Random(1)
    alone = [(n, Searcher([n])) for n in NOTICES]
    for number in range(120):
        notice, searcher = alone[number % len(alone)]
        filler = " ".join(rng.choice(["lorem", "license", "the", "éa", "public"]) for _ in range(8))
        words = normal(f"{filler} {mutated(rng, notice.words, rng.randrange(0, notice.edits + 4))} {filler}")
        wanted = least_edits(notice.words, words)
        found = [edits for _, _, _, edits in searcher.matches(words)]
        assert bool(found) == (wanted <= notice.edits)
        assert not found or min(found) == wanted
        for _, start, stop, edits in searcher.matches(words):
            assert least_edits(notice.words, words[start:stop]) == edits


def test_pieces_cover_the_notice_and_are_one_more_than_its_edits():
    for notice in NOTICES + PHRASES:
        pieces = notice.pieces()
        assert "".join(p for _, p in pieces) == notice.words and len(pieces) == notice.edits + 1
        assert all(notice.words[a : a + len(p)] == p for a, p in pieces)


def test_the_better_of_two_overlapping_notices():
    n, spans = Searcher(NOTICES).search("It is Licensed -- under (CC) BY-NC 4.0!")
    assert n == 9 and [(s["label"], s["edits"]) for s in spans] == [("cc-by-nc", 0)]


def test_spans_are_places_of_the_text():
    text = "Ünder (relaesed  under, THE\nMIT-License.) Released under the MIT license"
    n, spans = Searcher(PHRASES + NOTICES).search(text)
    assert n == 11
    assert [(s["label"], s["phrase"], s["word"], text[s["start"] : s["stop"]]) for s in spans] == [
        ("mit", False, 1, "relaesed  under, THE\nMIT-License"),
        ("mit", True, 4, "MIT-License"),
        ("mit", False, 6, "Released under the MIT license"),
        ("mit", True, 9, "MIT license"),
    ]
    assert spans[0]["edits"] == 2 and spans[2]["likeness"] == 1.0


def test_phrases_are_whole_words_and_count_each_time():
    _, spans = Searcher(PHRASES).search("mit license mit-licensemit license MIT\x7fLicense admit license mit licenses")
    assert [s["word"] for s in spans] == [0, 5]
    assert [s["label"] for s in Searcher(PHRASES).search("General public license; apache license")[1]] == ["gpl", "apache"]


def test_edge_cases(spark):
    long = "filler words " * 60_000 + "lizensed under the apache license version 2.0" + " more" * 60_000
    rows = [(1, None, 5, "x"), (2, "", 6, "y"), (3, " .,; ", 7, None), (4, long, 8, "z"), (4, long, 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string").repartition(2)
    found = licenses.scan_licenses(docs)
    assert found.columns == ["doc_id", "text", "label", "n_words", "spans"]
    got = {(r.doc_id, r.label): (r.n_words, [(s.label, s.phrase, s.edits) for s in r.spans]) for r in found.collect()}
    assert found.count() == 5
    assert got.pop((4, "z")) == (180_008, [("apache", False, 1), ("apache", True, 0)])
    assert got == {(1, "x"): (0, []), (2, "y"): (0, []), (3, None): (0, [])}
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_very_many_places(spark):
    text = "mit license " * 5000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = licenses.scan_licenses(docs).collect()
    assert len(row.spans) == 5000 and row.spans[-1].word == 9998


def test_own_notices(spark):
    docs = spark.createDataFrame([(1, "All rights reservd by us"), (2, "nothing")], "doc_id long, text string")
    found = licenses.scan_licenses(docs, [Notice("closed", "all rights reserved")]).collect()
    assert {r.doc_id: [s.label for s in r.spans] for r in found} == {1: ["closed"], 2: []}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_license_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        words, base = plain_base(docs[r.doc_id])
        at = [i for i, _ in base]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score == 0) == (r.labels == "") and 0 <= r.score <= 1
