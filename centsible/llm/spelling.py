"""Spelling variants: words that are one inserted, deleted or replaced character apart, and the form each stands for.

1. *Words* are the runs of letters of all texts, counted on the executors before anything is shuffled.
2. *Rotations.* A word is closed by a terminator and rotated to every place. The rotation that begins behind a place
   ends with the character at that place; without this last character it is a prefix that all words share
   that differ there only. The whole rotation of a word one character shorter is the same prefix. So sorted
   rotations have, for each prefix, first the shorter word (if there is one) and then one word per character.
3. *Groups.* Rows of one prefix are brought together. A group has a row per character of the alphabet and one more at
   most, whatever the corpus, so its members can be compared with each other. A character that repeats the one before it
   can be deleted at either place with the same result; only the first of such a run counts.
4. A word's *form* is its near word of largest count, if that is ``AT_LEAST_TIMES`` its own; forms are followed to
   the last by doubling the steps, since counts at least double with each.

A row carries its prefix, the character and the count; the word is put together again from these. For words over
``LONG`` characters the prefix is an MD5 digest and the word its own, so rows stay small; their near
words are joined to them afterwards.

Edge cases: null and empty texts have no words; repeated rows count as often as they are there; a null doc_id is an
empty text where ``slip`` uses it; ties between near words go to the smaller in code-point order; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.llm.arrays import LOWER, byte_class, column, pieces, quiet, span_hashes, spans, text_column
from centsible.llm.frames import map_batches, written

#: A word has so many characters at least, and occurs so often.
LEAST_LENGTH, LEAST_COUNT = 5, 3
AT_LEAST_TIMES = 2
END = "$"
#: Longer words are told apart by digests while they are grouped.
LONG = 200
#: A worker holds so many different words, or bytes of them, before it gives out their counts.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
PIECE = 1 << 20
#: Runs of more bytes are summed up one by one.
SHORT_RUN = 48
#: Every so-manieth occurrence of the slip rule loses a character.
SLIP = 97

ASCII_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 32
CONTINUES = byte_class((0x80, 0xBF))
#: CRC-32 of each byte, by the rule of the reversed polynomial.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
FLIP = np.uint32(0xFFFFFFFF)


def letter_runs(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [A-Za-z\\u00C0-\\u00FF]+ by row: the latter are the bytes C3 and what follows it."""
    inside = ASCII_LETTERS[data]
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return spans(inside, begin)


def crc32_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span continued from the checksum before it."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, length = starts[order], size[order]
    state = before[order].astype(np.uint32) ^ FLIP
    long = int(np.searchsorted(-length, -SHORT_RUN))  # those before this place
    for k in range(int(length[long]) if long < len(length) else 0):
        some = slice(long, int(np.searchsorted(-length, -k)))
        state[some] = CRC[(state[some] ^ data[at[some] + k]) & np.uint32(0xFF)] ^ (state[some] >> np.uint32(8))
    state ^= FLIP
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + length[i]].tobytes(), int(before[order[i]]))
    found = np.empty(len(size), np.uint32)
    found[order] = state
    return found


def count_words(docs: DataFrame, slips: bool = True) -> DataFrame:
    """word, n of the words of all texts, A-Z lower-cased. With ``slips``, an occurrence whose CRC-32 of
    ``<doc_id>:<word>`` is divisible by ``SLIP`` is counted as the word without the character at that checksum modulo
    its length: misspellings that anyone can make again."""

    def run(batches):
        held: dict[bytes, int] = {}
        size = 0

        def given():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            ids = column(batch, "id")
            for first_row, end_row, data, begin in pieces(text_column(batch), PIECE):
                if not len(data):
                    continue
                starts, ends, first = letter_runs(data, begin)
                if not len(starts):
                    continue
                data = LOWER_BYTES[data]
                slipped = np.zeros(len(starts), bool)
                if slips:
                    prefix = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first_row:end_row].tolist()]
                    check = crc32_of_runs(data, starts, ends, np.repeat(np.array(prefix, np.uint32), np.diff(first)))
                    slipped = check % SLIP == 0
                    for a, b, h in zip(starts[slipped].tolist(), ends[slipped].tolist(), check[slipped].tolist()):
                        word = data[a:b].tobytes().decode()
                        if len(word) > LEAST_LENGTH:
                            place = h % len(word)
                            word = (word[:place] + word[place + 1 :]).encode()
                            size += 0 if word in held else len(word)
                            held[word] = held.get(word, 0) + 1
                extra = np.concatenate(([0], np.cumsum(CONTINUES[data])))
                long = ends - starts - (extra[ends] - extra[starts]) >= LEAST_LENGTH
                own = np.flatnonzero(long & ~slipped)
                with quiet():
                    hashes = span_hashes(data, starts, ends, LOWER)[own]
                _, where, count = np.unique(hashes, return_index=True, return_counts=True)
                for a, b, n in zip(starts[own[where]].tolist(), ends[own[where]].tolist(), count.tolist()):
                    word = data[a:b].tobytes()
                    size += 0 if word in held else b - a
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield given()
                    held, size = {}, 0
        if held:
            yield given()

    source = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    return map_batches(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- rotations -------------------------------------------------------------------------------


def _rotations(words: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """word, n, key, skipped: for each place of a word the whole rotation (skipped is empty) and, up to its end, the
    rotation without its last character. ``wanted`` says for which lengths of the shorter word."""
    length = F.char_length("word")
    placed = words.select("word", "n", length.alias("length"), F.explode(F.sequence(F.lit(0), length)).alias("place"))
    head = F.expr("substring(word, 1, place)")
    whole = F.struct(F.concat(F.expr("substring(word, place + 1)"), F.lit(END), head).alias("key"), F.lit("").alias("skipped"))
    rest = F.concat(F.expr("substring(word, place + 2)"), F.lit(END), head)
    less = F.struct(rest.alias("key"), F.expr("substring(word, place + 1, 1)").alias("skipped"))
    kept = F.array_compact(
        F.array(
            F.when(wanted(F.col("length")), whole),
            F.when(wanted(F.col("length") - 1) & (F.col("place") < F.col("length")), less),
        )
    )
    return placed.select("word", "n", F.inline(kept))


def _meeting(groups: DataFrame) -> DataFrame:
    """Each member (one) of each group (members) with the others that it is near, by key and skipped character."""
    met = groups.where(F.size("members") > 1).select("*", F.explode("members").alias("one"))
    again = F.right(F.col("key"), F.lit(1))  # a skipped character like this one repeats it
    own = F.col("one.skipped")
    near = F.filter(
        "members",
        lambda o: (o["skipped"] != own)
        & ((own != "") | (o["skipped"] != again))
        & ((o["skipped"] != "") | (own != again)),
    )
    return met.withColumn("near", near).where(F.size("near") > 0)


def _short_neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (least n, then word) of groups whose shorter word has LONG characters at most."""
    rows = _rotations(words.where(F.char_length("word") <= LONG + 1), lambda n: n <= LONG).select("key", "skipped", "n")
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("n", "skipped")).alias("members"))
    head, tail = F.substring_index("key", END, -1), F.substring_index("key", END, 1)
    word = lambda skipped: F.concat(head, skipped, tail)
    met = _meeting(groups)
    best = F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("less"), word(o["skipped"]).alias("word"))))
    return met.select(word(F.col("one.skipped")).alias("word"), F.size("near").cast("long").alias("n_near"), best.alias("best"))


def _long_neighbours(words: DataFrame) -> DataFrame:
    """The same for the longer ones, whose rows carry digests."""
    words = words.where(F.char_length("word") >= LONG + 1).withColumn("id", F.md5("word"))
    rows = _rotations(words, lambda n: n > LONG)
    key = F.concat(F.md5("key"), F.right(F.col("key"), F.lit(1)))
    rows = rows.select(key.alias("key"), "skipped", "n", F.md5("word").alias("id"))
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("n", "skipped", "id")).alias("members"))
    pairs = _meeting(groups).select(F.col("one.id").alias("id"), F.explode("near").alias("other"))
    pairs = pairs.select("id", (-F.col("other.n")).alias("less"), F.col("other.id").alias("other_id"))
    others = words.select(F.col("id").alias("other_id"), F.col("word").alias("other_word"))
    found = pairs.join(others, "other_id").join(words.select("id", "word"), "id")
    best = F.struct("less", F.col("other_word").alias("word"))
    return found.select("word", F.lit(1).cast("long").alias("n_near"), best.alias("best"))


def with_forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n (null if no near word is frequent enough) of a table of words and counts."""
    kind = "struct<less: bigint, word: string>"
    own = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(kind).alias("best"), "n")
    near = [part(words).withColumn("n", F.lit(None).cast("long")) for part in (_short_neighbours, _long_neighbours)]
    rows = own.unionByName(near[0]).unionByName(near[1])
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    stands = -F.col("best.less") >= AT_LEAST_TIMES * F.col("n")
    return found.select(
        "word",
        "n",
        "n_near",
        F.when(stands, F.col("best.word")).alias("form"),
        F.when(stands, -F.col("best.less")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """With ``root``: the end of the chain of forms. Each round doubles the steps, so there are as many as the
    logarithm of the longest chain, itself at most that of the largest count."""
    steps = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    open_ends = True
    while open_ends:
        steps = written(steps.select("word", "root"), "roots")
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("next"))
        open_ends = not steps.join(further, steps["root"] == further["via"], "left_semi").isEmpty()
        if open_ends:
            joined = steps.join(further, steps["root"] == further["via"], "left")
            steps = joined.select("word", F.coalesce("next", "root").alias("root"))
    ends = steps.select(F.col("word").alias("of"), "root")
    return forms.join(ends, forms["word"] == ends["of"], "left").drop("of").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, slips: bool = True) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text)."""
    counted = count_words(docs, slips).where(F.col("n") >= LEAST_COUNT)
    return with_roots(written(with_forms(written(counted, "words")), "forms"))
