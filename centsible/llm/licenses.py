"""License scans: short notices found with up to a bounded number of edits, and exact phrases of whole words.

Texts are compared as words joined by one space, A-Z lower-cased. A notice with k edits is cut into k + 1 pieces.
Whatever is k edits away holds one piece unchanged, so every place where a piece stands is a candidate and no
other place can be one. Around each candidate the ``regex`` library looks for the best match of the whole notice with
at most k characters inserted, deleted or replaced. Of matches that overlap, of one notice or of several, the one
with the fewest edits stays, then that of the longest notice, then the earliest and shortest.

A phrase is a notice without edits, of whole words; its only piece is itself, and every place counts.

It is one map pass. A task holds one batch of texts; the notices are a short list given by the caller.

Edge cases: null and empty texts have no words and no spans; texts of any length are searched whole; repeated rows are
judged alike; an empty table gives no rows; other columns stay, those named ``n_words`` or ``spans`` are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import text_column
from centsible.llm.frames import brought_back, map_batches, set_aside, without

#: A notice may have an edit for so many of its characters, and so many at most.
CHARACTERS_PER_EDIT, MOST_EDITS = 12, 4

SPAN = "struct<label: string, phrase: boolean, word: bigint, start: bigint, stop: bigint, edits: int, likeness: double>"

#: Digits, letters (small ones only) and all bytes beyond ASCII; the rest separates words.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal(text: str) -> str:
    """The words of a text, A-Z lower-cased, with one space between them."""
    return b" ".join(text.encode().translate(_WORD_BYTES).split()).decode()


@dataclass(frozen=True)
class Notice:
    """A label and the text that stands for it. Phrases are whole words without edits."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> str:
        return normal(self.text)

    @property
    def edits(self) -> int:
        return 0 if self.phrase else min(MOST_EDITS, len(self.words) // CHARACTERS_PER_EDIT)

    def pieces(self) -> list[tuple[int, str]]:
        """Where each of edits + 1 pieces of about the same length begins, and the piece."""
        words, n = self.words, self.edits + 1
        cuts = [len(words) * k // n for k in range(n + 1)]
        return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


# fixed values: phrases and labels of the exact search
PHRASES = [
    Notice("mit", "mit license", phrase=True),
    Notice("apache", "apache license", phrase=True),
    Notice("gpl", "general public license", phrase=True),
]
#: Usual sentences of notices in source files and documents, and the licenses they name.
NOTICES = [
    Notice("mit", "Released under the MIT License"),
    Notice("mit", "Licensed under the MIT License"),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Notice("apache", "Licensed under the Apache License, Version 2.0"),
    Notice("gpl", "Licensed under the GNU General Public License"),
    Notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"),
    Notice("lgpl", "GNU Lesser General Public License"),
    Notice("agpl", "GNU Affero General Public License"),
    Notice("mpl", "subject to the terms of the Mozilla Public License"),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    Notice("cc-by", "Licensed under CC BY 4.0"),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Notice("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Notice("unlicense", "This is free and unencumbered software released into the public domain"),
]


class Searcher:
    """Finds the spans of notices in normalised texts."""

    def __init__(self, notices: list[Notice]):
        self.phrases = [n for n in notices if n.phrase and n.words]
        self.fuzzy = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for notice in notices:
            if notice.phrase or not notice.words:
                continue
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice.words)}){{e<={notice.edits}}}")
            for begin, piece in notice.pieces():
                seeds.setdefault(piece, []).append((len(self.fuzzy), begin))
            self.fuzzy.append((notice, pattern))
        self.seeds = list(seeds.items())

    def places(self, words: str) -> list[tuple[Notice, int, int, int]]:
        """(notice, start, stop, edits) of the phrases."""
        framed, found = f" {words} ", []
        for notice in self.phrases:
            wanted = f" {notice.words} "
            at = framed.find(wanted)
            while at >= 0:
                found.append((notice, at, at + len(notice.words), 0))
                at = framed.find(wanted, at + 1)
        return found

    def matches(self, words: str) -> list[tuple[Notice, int, int, int]]:
        """(notice, start, stop, edits) of the other notices."""
        windows: dict[int, set[int]] = {}
        for piece, uses in self.seeds:
            at = words.find(piece)
            while at >= 0:
                for number, begin in uses:
                    windows.setdefault(number, set()).add(at - begin)
                at = words.find(piece, at + 1)
        best = []
        for number, starts in windows.items():
            notice, pattern = self.fuzzy[number]
            for start in starts:
                match = pattern.search(words, max(0, start - notice.edits), start + len(notice.words) + notice.edits)
                if match:
                    best.append((sum(match.fuzzy_counts), -len(notice.words), match.start(), match.end(), number))
        return [(self.fuzzy[number][0], a, b, edits) for edits, _, a, b, number in _apart(best)]

    def search(self, text: str) -> tuple[int, list[dict]]:
        """Number of words, and the spans in code points of the text."""
        words = normal(text)
        found = self.places(words) + self.matches(words)
        if not found:
            return words.count(" ") + 1 if words else 0, []
        return words.count(" ") + 1, _spans(text, words, found)


def _apart(matches: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of matches (edits, less by length, start, stop, notice) in that order, those free of the ones before."""
    kept = []
    taken = bytearray(max((m[3] for m in matches), default=0))
    for match in sorted(set(matches)):
        start, stop = match[2:4]
        if not any(taken[start:stop]):
            kept.append(match)
            taken[start:stop] = b"\x01" * (stop - start)
    return kept


def _spans(text: str, words: str, found: list[tuple[Notice, int, int, int]]) -> list[dict]:
    """The places in the words as places in the text: from the first to the last word character."""
    begin = [m.start() for m in _WORD.finditer(text)]
    opens, at = [0], words.find(" ")
    while at >= 0:
        opens.append(at + 1)
        at = words.find(" ", at + 1)
    out = []
    for notice, start, stop, edits in sorted(found, key=lambda f: (f[1], f[2], f[0].label, not f[0].phrase)):
        while start < stop - 1 and words[start] == " ":
            start += 1
        while stop - 1 > start and words[stop - 1] == " ":
            stop -= 1
        first, last = _word_at(opens, start), _word_at(opens, stop - 1)
        out.append(
            {
                "label": notice.label,
                "phrase": notice.phrase,
                "word": first,
                "start": begin[first] + start - opens[first],
                "stop": begin[last] + stop - opens[last],
                "edits": edits,
                "likeness": 1 - edits / len(notice.words),
            }
        )
    return out


def _word_at(opens: list[int], place: int) -> int:
    return bisect_right(opens, place) - 1


def scan_licenses(docs: DataFrame, notices: list[Notice] | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_words`` (long) and ``spans``: array of (label, phrase, word, start, stop, edits,
    likeness) in order of their place, start and stop in code points of the text, word counted from 0."""
    notices = PHRASES + NOTICES if notices is None else notices
    docs = without(docs, "n_words", "spans")
    aside = set_aside(docs, "text")

    def run(batches):
        searcher = Searcher(notices)
        for batch in batches:
            found = [searcher.search(text or "") for text in text_column(batch).to_pylist()]
            n_words, spans = pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], span_list)
            yield pa.RecordBatch.from_arrays([*batch.columns, n_words, spans], [*batch.schema.names, "n_words", "spans"])

    span_list = pa.list_(
        pa.struct(
            {
                "label": pa.string(),
                "phrase": pa.bool_(),
                "word": pa.int64(),
                "start": pa.int64(),
                "stop": pa.int64(),
                "edits": pa.int32(),
                "likeness": pa.float64(),
            }
        )
    )
    schema = T.StructType([*aside.schema.fields])
    for name, kind in (("n_words", "bigint"), ("spans", f"array<{SPAN}>")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    made = map_batches(aside, run, schema)
    return made.select(*brought_back(made, docs, "text"), "n_words", "spans")


def phrases_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["phrase"])


def labels_text(spans: Column) -> Column:
    """Distinct labels, sorted, with commas between."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def likeness(spans: Column) -> Column:
    """Of the best span; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["likeness"])), F.lit(0.0))
