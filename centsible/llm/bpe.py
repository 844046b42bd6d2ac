"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

A word is held as two contiguous lists: the ids of its parts (what stands between two boundaries) and the ranks of
adjacent pairs. The lowest rank is found by a scan, its boundary deleted, and the two neighbouring
ranks are looked up again, until no pair has a rank. Words of more than ``SHORT`` parts use a heap of
the same pairs, because repeated scans grow with the square of the length.

Edge cases: null and empty texts have no ids; a text of white space only has none; special tokens
written out in a text become their ids, as the library does; repeated rows are encoded each; an empty
table gives no rows. ``encode`` keeps all columns of its input and adds ``ids`` and ``n_tokens``, which
replace columns of these names (``decode`` likewise for its output column).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from centsible.llm.arrays import pieces, text_column
from centsible.llm.frames import map_batches, without

SHORT = 200
#: Words kept with their ids per Python worker; all are forgotten when the number is reached.
KEPT_WORDS = 100_000
KEPT_LENGTH = 40
NO_RANK = 1 << 60
# Fixed value: what the library counts as white space.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class WordCache(dict):
    def __init__(self, encode_word):
        super().__init__()
        self.encode_word = encode_word

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode_word(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A BPE vocabulary with word ends, read from a ``tokenizer.json`` file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for left, right in model["merges"]:
            self.ranks[self.vocab[left], self.vocab[right]] = len(self.merged)
            self.merged.append(self.vocab[left + right])
        letters = byte_letters()
        self.first_ids = [self.vocab[x] for x in letters]
        self.last_ids = [self.vocab[x + self.end] for x in letters]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"[^\s", f"[^{SPACE}"), regex.V0).findall
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.special else None
        self.cache = WordCache(self.encode_word)

    # ---- one word ----

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        parts = [self.first_ids[b] for b in data[:-1]]
        parts.append(self.last_ids[data[-1]])
        return tuple(self._scan(parts) if len(parts) <= SHORT else self._heap(parts))

    def _scan(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            parts[at] = merged[low]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, at = heapq.heappop(waiting)
            right = after[at]
            if parts[at] < 0 or right >= n or get((parts[at], parts[right])) != rank:
                continue  # one of the two was merged meanwhile
            parts[at], parts[right] = merged[rank], -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
                if (next_rank := get((parts[at], parts[after[at]]))) is not None:
                    heapq.heappush(waiting, (next_rank, at))
            if (left := before[at]) >= 0 and (left_rank := get((parts[left], parts[at]))) is not None:
                heapq.heappush(waiting, (left_rank, left))
        return [p for p in parts if p >= 0]

    # ---- whole texts ----

    def _segment(self, text: str) -> chain:
        if text.isascii():
            found = self.plain_words(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # letter by letter where the whole string's rule for a final sigma would differ
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            found = self.words(text)
        return chain.from_iterable(map(self.cache.__getitem__, found))

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if not text:
            return ids
        if self.special_split and "<" in text:
            for part in self.special_split(text):
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    ids.extend(self._segment(part))
        else:
            ids.extend(self._segment(text))
        return ids

    def decode(self, ids) -> str:
        """The tokens joined by one space: what the library gives for a file without a decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=4)
def load(spec: str) -> Bpe:
    """One vocabulary per Python worker, kept between tasks."""
    return Bpe(json.loads(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array of int) and ``n_tokens`` (long) of the column ``text``; on demand
    also the ids decoded again, in a column of the given name, by the same workers."""
    docs = without(docs, "ids", "n_tokens", *([decoded] if decoded else []))
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))  # one vocabulary file

    def run(batches):
        bpe = load(held.value)
        for batch in batches:
            # a few MB of text at a time, so that ids never pile up
            for piece in _slices(batch):
                ids = [bpe.encode(text) for text in text_column(piece).to_pylist()]
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                begin = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                flat = np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32)
                found = [pa.ListArray.from_arrays(pa.array(begin), pa.array(flat)), pa.array(count)]
                if decoded:
                    found.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *found], [*piece.schema.names, *(f.name for f in added)]
                )

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text of its ``ids`` (null ids: null)."""
    docs = without(docs, column)
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        bpe = load(held.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            end = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts, valid, at = [], ids.is_valid().to_pylist(), 0
            for stop, has in zip(end, valid):
                texts.append(bpe.decode(flat[at:stop].tolist()) if has else None)
                at = stop
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column]
            )

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.StringType())]))


def _slices(batch: pa.RecordBatch, size: int = 2 << 20):
    for first, end, _, _ in pieces(text_column(batch), size):
        yield batch.slice(first, end - first)
