"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is described by
the rates of byte-class pairs and by how its words repeat, and encoded by one tanh layer. A gated
attention (tanh times sigmoid) weighs the passages, the weighted mean is the document's representation, and a logistic
unit scores it. Attention and encoder are learned from document labels only, by Adam on the log loss.

Fitting takes a bounded sample of labelled rows: the ``max_docs`` labelled documents with the lowest hash of doc_id, one
row each, and of these, in the same order, those whose passages are ``max_passages`` together at most. All passages
of a document in the sample are learned from. Scoring reads all passages of all documents.

Edge cases: null and empty texts are one empty passage; a label that is null, or that differs between
rows of one doc_id, is not learned; of rows with the same doc_id the text with the smallest hash is learned from; with no label to learn every score is 0.5 and with a single class it is
that class; repeated rows are scored each; an empty table gives no rows; ``score`` keeps all columns of its
input; those that it adds replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.arrays import LOWER, NOT_SPACE, pieces, quiet, span_hashes, spans, text_column
from centsible.llm.frames import map_batches, text_id, without, written

PASSAGE = 128
MAX_DOCS = 6000
#: Of all sampled documents together: about 60 MB of features.
MAX_PASSAGES = 100_000
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 4e-3, 1e-4


def _byte_classes() -> np.ndarray:
    """A class for each byte: what kind of character it is, with common marks apart."""
    kind = np.zeros(256, np.int64)  # control
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"-:;()"]
    for number, group in enumerate(groups, 1):
        kind[[ord(c) for c in group]] = number
    for b in range(33, 127):
        if kind[b] == 0:
            kind[b] = len(groups) + 1  # symbols
    kind[128:] = len(groups) + 2
    return kind


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 6


def passage_counts(data: np.ndarray, begin: np.ndarray):
    """Number of passages of each row of a piece, and the spans of its words."""
    found = spans(NOT_SPACE[data], begin)
    return np.maximum(1, -(-np.diff(found[2]) // PASSAGE)), found


def passage_features(texts: pa.Array):
    """Per piece of the column: features of all passages and where each row's passages begin."""
    for _, _, data, begin in pieces(texts):
        n_passages, (starts, ends, first) = passage_counts(data, begin)
        words = span_hashes(data, starts, ends, LOWER)
        n_words = np.diff(first)
        row_of_word = np.repeat(np.arange(len(n_words)), n_words)
        opens = np.concatenate(([0], np.cumsum(n_passages)))
        passage = opens[row_of_word] + (np.arange(len(words)) - first[row_of_word]) // PASSAGE
        total = opens[-1]
        # a byte belongs to the passage of the word that begins at or before it
        bounds = np.zeros(total + 1, np.int64)
        heads = np.flatnonzero(np.diff(passage, prepend=-1) != 0) if len(words) else np.zeros(0, np.int64)
        bounds[:-1][opens[:-1]] = begin[:-1]
        inner = passage[heads]
        later = ~np.isin(inner, opens[:-1])
        bounds[inner[later]] = starts[heads[later]]
        bounds[-1] = len(data)
        size = np.diff(bounds)
        kind = CLASSES[data]
        pairs = kind[:-1] * N_CLASSES + kind[1:] if len(data) > 1 else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(total), size)
        both = owner[1:] == owner[:-1]
        counts = np.bincount((owner[:-1] * (N_CLASSES * N_CLASSES) + pairs)[both], minlength=total * N_CLASSES * N_CLASSES)
        rates = np.sqrt(counts.reshape(total, -1) / np.maximum(size - 1, 1)[:, None])

        n = np.bincount(passage, minlength=total)
        at_least_1 = np.maximum(n, 1)
        order = np.lexsort((words, passage))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        distinct = np.bincount(passage[order][fresh], minlength=total) / at_least_1
        twice = np.zeros(len(words), bool)
        twice[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
        stutter = np.bincount(passage[twice], minlength=total) / at_least_1
        length = (ends - starts).astype(float)
        mean = np.bincount(passage, length, minlength=total) / at_least_1
        spread = np.sqrt(np.maximum(np.bincount(passage, length**2, minlength=total) / at_least_1 - mean**2, 0))
        more = np.column_stack((distinct, stutter, mean / 10, spread / 10, np.log1p(n) / 5, n == 0))
        yield np.hstack((rates, more)).astype(np.float32), opens


@dataclass
class MilModel:
    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of every bag and attention weight of every passage."""
        forward = _forward(self.weights, (x - self.center) / self.scale, opens)
        return forward["score"], forward["attention"]


def _sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


def _forward(w, x, opens):
    starts, sizes = opens[:-1], np.diff(opens)
    h = np.tanh(x @ w["encode"] + w["encode_0"])
    signal, gate = np.tanh(h @ w["signal"]), _sigmoid(h @ w["gate"])
    logit = (signal * gate) @ w["attend"]
    peak = np.repeat(np.maximum.reduceat(logit, starts), sizes)
    e = np.exp(logit - peak)
    attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * attention[:, None], starts)
    score = _sigmoid(z @ w["score"] + w["score_0"])
    return {"h": h, "signal": signal, "gate": gate, "attention": attention, "z": z, "score": score}


def _gradients(w, x, opens, label):
    f = _forward(w, x, opens)
    starts, sizes = opens[:-1], np.diff(opens)
    d_out = (f["score"] - label) / len(label)
    d_z = d_out[:, None] * w["score"]
    d_zr = np.repeat(d_z, sizes, axis=0)
    d_h = d_zr * f["attention"][:, None]
    d_att = (d_zr * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(d_att * f["attention"], starts), sizes)
    d_logit = f["attention"] * (d_att - mean)
    d_sg = d_logit[:, None] * w["attend"]
    d_signal = d_sg * f["gate"] * (1 - f["signal"] ** 2)
    d_gate = d_sg * f["signal"] * f["gate"] * (1 - f["gate"])
    d_h = d_h + d_signal @ w["signal"].T + d_gate @ w["gate"].T
    d_pre = d_h * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ d_pre,
        "encode_0": d_pre.sum(0),
        "signal": f["h"].T @ d_signal,
        "gate": f["h"].T @ d_gate,
        "attend": (f["signal"] * f["gate"]).T @ d_logit,
        "score": f["z"].T @ d_out,
        "score_0": np.array([d_out.sum()]),
    }


def fit_bags(x: np.ndarray, opens: np.ndarray, label: np.ndarray, seed: int = 7) -> MilModel:
    """Learn from bags: passages ``opens[i]:opens[i+1]`` of x belong to bag i. Bags come in a fixed order."""
    center, scale = x.mean(0), x.std(0) + 0.02
    x = ((x - center) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "encode": draw(x.shape[1], HIDDEN),
        "encode_0": np.zeros(HIDDEN),
        "signal": draw(HIDDEN, GATES),
        "gate": draw(HIDDEN, GATES),
        "attend": draw(GATES),
        "score": draw(HIDDEN),
        "score_0": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-5
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            rows = np.concatenate([np.arange(opens[i], opens[i + 1]) for i in picked])
            inner = np.concatenate(([0], np.cumsum(opens[picked + 1] - opens[picked])))
            step += 1
            for k, g in _gradients(w, x[rows], inner, label[picked]).items():
                if k in ("encode", "score"):
                    g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(center, scale, w)


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> MilModel | float:
    """Learn from documents and ``labels`` (doc_id, quality); without two classes, the score that all get."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .where("quality = high")
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id", "quality")
    rows = docs.select("doc_id", F.struct(text_id().alias("tid"), "text").alias("row")).join(F.broadcast(sample), "doc_id")
    # one row per sampled id: max_docs at most, however often an id is repeated
    rows = rows.groupBy("doc_id", "quality").agg(F.min("row").alias("row"))
    rows = written(rows.select("doc_id", "quality", "row.text", F.xxhash64("doc_id").alias("turn")), "labelled")

    def count(batches):
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            with quiet():
                n += [passage_counts(data, begin)[0] for _, _, data, begin in pieces(text_column(batch))]
            names = ["doc_id", "turn"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(n))], [*names, "n"])

    kind = rows.schema["doc_id"]
    counted = map_batches(rows, count, T.StructType([kind]).add("turn", "long").add("n", "long")).collect()
    room, taken = max_passages, []
    for r in sorted(counted, key=lambda r: (r.turn, r.doc_id)):
        if r.n <= room:
            taken.append(r.doc_id)
            room -= r.n
    if len(taken) < len(counted):
        ids = docs.sparkSession.createDataFrame([(i,) for i in taken], T.StructType([kind]))
        rows = rows.join(F.broadcast(ids), "doc_id")  # max_docs ids

    def run(batches):
        for batch in batches:
            with quiet():
                found = []
                for x, opens in passage_features(text_column(batch)):
                    found += [x[a:b].tobytes() for a, b in zip(opens[:-1], opens[1:])]
                columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "quality", "features"])

    schema = T.StructType([*(rows.schema[n] for n in ("doc_id", "quality")), T.StructField("features", T.BinaryType())])
    # at most max_docs documents of max_passages passages together
    got = sorted(map_batches(rows, run, schema).collect(), key=lambda r: r.doc_id)
    if not got:
        return 0.5
    label = np.array([float(r.quality) for r in got])
    if label.min() == label.max():
        return float(label[0])
    bags = [np.frombuffer(bytes(r.features), np.float32).reshape(-1, N_FEATURES) for r in got]
    opens = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return fit_bags(np.vstack(bags), opens, label)


def score(docs: DataFrame, model: MilModel | float) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), ``n_passages`` and ``top_passage``, the one with the most weight."""
    added = [("score", T.DoubleType()), ("n_passages", T.LongType()), ("top_passage", T.LongType())]
    docs = without(docs, *(n for n, _ in added))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        mil = held.value
        for batch in batches:
            with quiet():
                scores, count, top = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x, opens in passage_features(text_column(batch)):
                    count.append(np.diff(opens))
                    if isinstance(mil, float):
                        scores.append(np.full(len(opens) - 1, mil))
                        top.append(np.zeros(len(opens) - 1, np.int64))
                        continue
                    value, attention = mil.bags(x, opens)
                    scores.append(value)
                    order = np.lexsort((np.arange(len(attention)), -attention, np.repeat(np.arange(len(opens) - 1), np.diff(opens))))
                    top.append(order[opens[:-1]] - opens[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(np.concatenate(v)) for v in (scores, count, top))],
                    [*batch.schema.names, *(n for n, _ in added)],
                )

    return map_batches(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)]))
