"""Language identification: each document as a mixture of languages.

The likelihood of a word in a language is that of its byte ``GRAM``-grams (white space around it included),
counted over all training texts of the language. Expectation-maximisation estimates the shares of the
languages in a document, from all its words. The set of languages is chosen by penalised likelihood (BIC):
starting with all, the language of the least share is dropped as long as that lowers the criterion.
The prediction is the language with the largest share of the chosen set.

Edge cases: null text and text without a letter are ``und`` with score 0; rows without a language are not
learned; without any training text every document is ``und``; ties between languages go to the first by
name; repeated rows are each judged; an empty table gives no rows; ``predict`` keeps all columns of its
input; those that it adds replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import NOT_SPACE, U64, constants, pieces, quiet, ranges, spans, text_column
from centsible.llm.frames import grouped, map_batches, without

GRAM = 4
BUCKETS = 1 << 16
#: Counts travel in blocks of so many buckets.
BLOCK = 1 << 12
SMOOTHING = 0.5
#: A byte is part of GRAM grams, so a gram counts as this much evidence.
EVIDENCE = 1.0 / GRAM
ROUNDS = 12
PENALTY = 2.0
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def word_grams(texts: pa.Array):
    """Per piece: bucket of every gram, where each word's grams begin, where each row's words begin, row has a letter."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    # a space after every text, so that no gram reaches into the next one
    spaced = pc.binary_join_element_wise(lowered, "", " ")
    for first_row, _, data, begin in pieces(spaced):
        inside = NOT_SPACE[data]
        starts, ends, first = spans(inside, begin)
        # a word of n bytes with a space on both sides has n + 2 - GRAM + 1 grams, one at least
        grams = np.maximum(ends - starts + 3 - GRAM, 1)
        opens = np.concatenate(([0], np.cumsum(grams)))
        clean = np.where(inside, data, 32).astype(np.uint32)
        padded = np.concatenate((np.full(1, 32, np.uint32), clean, np.full(GRAM, 32, np.uint32)))
        code = np.zeros(len(clean) + 1, np.uint32)
        for k in range(GRAM):
            code = code << np.uint32(8) | padded[k : k + len(code)]
        code = code[ranges(starts, grams)]
        alone = opens[:-1][ends - starts == 1]  # its gram would reach beyond the space after it
        code[alone] = code[alone] & np.uint32(0xFFFFFF00) | np.uint32(32)
        bucket = ((code ^ code >> np.uint32(15)) * HASH >> np.uint32(16)).astype(np.int64)
        letters = np.concatenate(([0], np.cumsum(LETTERS[data])))
        has = letters[begin[1:]] > letters[begin[:-1]]
        for row in np.flatnonzero(~has & (begin[1:] - begin[:-1] > 1)):
            has[row] = any(c.isalpha() for c in spaced[first_row + int(row)].as_py())
        yield bucket, opens, first, has


HASH = np.uint32(constants(1, 901)[0] >> U64(32)) | np.uint32(1)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # languages x buckets: log likelihoods


def fit(docs: DataFrame) -> LanguageModel:
    """Counts of all ``text`` with a ``lang``, summed on the executors; the sums are BUCKETS numbers a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            row = 0
            with quiet():
                for bucket, opens, first, _ in word_grams(batch.column(1)):
                    rows = len(first) - 1
                    row_of_gram = np.repeat(code[row : row + rows], np.diff(opens[first]))
                    for c in np.unique(row_of_gram):
                        found = np.bincount(bucket[row_of_gram == c], minlength=BUCKETS)
                        sums[names[c]] = sums.get(names[c], 0) + found
                    row += rows
        for name, total in sums.items():
            for block in range(BUCKETS // BLOCK):
                yield _row(name, block, total[block * BLOCK : (block + 1) * BLOCK])

    def add(batches):
        open_key, total = None, None
        for table in grouped(batches, ["lang", "block"]):
            for lang, block, data in zip(*(table.column(n).to_pylist() for n in ("lang", "block", "counts"))):
                if (lang, block) != open_key:
                    if open_key:
                        yield _row(*open_key, total)
                    open_key, total = (lang, block), np.zeros(BLOCK, np.int64)
                total = total + np.frombuffer(data, np.int64)
        if open_key:
            yield _row(*open_key, total)

    schema = "lang string, block int, counts binary"
    learned = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    parts = map_batches(learned, count, schema).repartition("lang", "block").sortWithinPartitions("lang", "block")
    rows = sorted((r.lang, r.block, bytes(r.counts)) for r in map_batches(parts, add, schema).toLocalIterator())
    languages = sorted({lang for lang, _, _ in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    for lang, block, data in rows:
        counts[block * BLOCK : (block + 1) * BLOCK, languages.index(lang)] = np.frombuffer(data, np.int64)
    share = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)
    return LanguageModel(languages, np.ascontiguousarray(np.log(share).T.astype(np.float32)))


def _row(lang, block, counts):
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([block], pa.int32()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())],
        ["lang", "block", "counts"],
    )


def _em(likely, starts, row, active) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the active languages per row, and the log likelihood without the words' peaks.

    ``likely`` is languages x words, ``active`` and the shares are languages x rows.
    """
    n = np.bincount(row, minlength=active.shape[1]).astype(likely.dtype)
    share = active / active.sum(0, dtype=likely.dtype)
    for _ in range(ROUNDS):
        part = likely * share[:, row]
        part /= np.maximum(part.sum(0), 1e-30)
        share = np.add.reduceat(part, starts, axis=1) / n * active
        share /= np.maximum(share.sum(0), 1e-30)
    fit = np.log(np.maximum((likely * share[:, row]).sum(0), 1e-30))
    return share, np.add.reduceat(fit.astype(float), starts)


def mixtures(table: np.ndarray, bucket, opens, first) -> np.ndarray:
    """Shares of the chosen languages of every row (zeros without words). ``table``: languages x buckets."""
    n_langs = len(table)
    words = np.diff(first)
    out = np.zeros((len(words), n_langs))
    some = np.flatnonzero(words)
    if not len(some):
        return out
    likely = np.stack([np.add.reduceat(one[bucket], opens[:-1]) for one in table]) * np.float32(EVIDENCE)
    likely = np.exp(likely - likely.max(0))
    n = words[some]
    row = np.repeat(np.arange(len(some)), n)
    active = np.ones((n_langs, len(some)), bool)
    share, fit = _em(likely, first[:-1][some], row, active)
    open_rows = np.arange(len(some))
    while len(open_rows):
        open_rows = open_rows[active[:, open_rows].sum(0) > 1]
        if not len(open_rows):
            break
        # languages that explain less than a hundredth of a word go at once, else the one with the least
        count, fewer = n[open_rows], active[:, open_rows].copy()
        s = np.where(fewer, share[:, open_rows], np.inf)
        kept = fewer.sum(0)
        least = s.argmin(0)
        fewer &= s >= 0.01 / count
        fewer[least, np.arange(len(least))] = False
        inside = np.isin(row, open_rows)
        starts = np.concatenate(([0], np.cumsum(count)))[:-1]
        new_share, new_fit = _em(likely[:, inside], starts, np.repeat(np.arange(len(count)), count), fewer)
        gone = kept - fewer.sum(0)
        better = -2 * new_fit - PENALTY * gone * np.log(count + 1) <= -2 * fit[open_rows]
        done = open_rows[better]
        active[:, done], share[:, done], fit[done] = fewer[:, better], new_share[:, better], new_fit[better]
        open_rows = done
    out[some] = share.T
    return out


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs``, ``lang_pred``, ``score`` (the share of that language) and ``shares`` of the chosen set."""
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
    docs = without(docs, *(f.name for f in added))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches):
        languages, table = held.value.languages, held.value.table
        for batch in batches:
            names, scores, shares = [], [], []
            with quiet():
                for bucket, opens, first, has in word_grams(text_column(batch)):
                    if not languages:
                        has = np.zeros(len(has), bool)
                        mix = np.zeros((len(has), 1))
                    else:
                        mix = mixtures(table, bucket, opens, first)
                    best = mix.argmax(1)
                    names += [languages[b] if h else "und" for b, h in zip(best, has)]
                    scores += np.where(has, mix[np.arange(len(best)), best], 0.0).tolist()
                    shares += [
                        [(languages[k], float(m[k])) for k in np.flatnonzero(m)] if h else [] for m, h in zip(mix, has)
                    ]
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in added)])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, *added]))
