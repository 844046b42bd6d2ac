from __future__ import annotations

from test_decontaminate import by_hand as hits_by_hand
from test_linededup import by_hand as lines_by_hand
from test_ngramjoin import by_hand as components_by_hand
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from centsible.llm import settings

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark):
    """Each stage is judged on its own input; the last one's digests against the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(docs)
        docs = stage(spark, docs, SF)
        if number < 4:
            assert docs.columns == COLUMNS
            docs = corpus_pipeline.written(docs, f"test{number}")
    first, scored, cut, single, clean = map(pairs, kept)

    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {i for i, _ in scored}
    assert sum((i in ids) == bool(label[i]) for i, _ in first if i in label) > 0.98 * len(label)
    assert set(scored) <= set(first)

    want = []
    judged = lines_by_hand(scored)
    for i, text in scored:
        n_lines, dropped = judged[i, text]
        gone = {d[0] for d in dropped}
        if n_lines == 0 or n_lines > len(gone):
            want.append((i, "\n".join(p for n, p in enumerate(text.split("\n")) if n not in gone)))
    assert sorted(cut) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())

    stays = {i for i, _, component in components_by_hand(cut) if i == component}
    assert sorted(single) == sorted(r for r in cut if r[0] in stays)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: hits_by_hand(text, items) for i, text in single}
    assert sorted(clean) == sorted(r for r in single if not 0 < 20 * hits[r[0]][1] >= hits[r[0]][0])

    library = Tokenizer.from_file(settings.VOCABULARY)
    tokens = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert tokens == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in clean}


def test_registered_run(spark):
    rows = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS and docs.count() == 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    """Columns named like those that the stages add come through every stage unchanged."""
    names = ["score", "n_passages", "n_lines", "dropped", "spans", "items", "n_words", "own_tid", "gone_id", "cls", "tid", "line", "ids"]
    texts = ["one two three four five six seven", None, "", "ONE two three four five six seven", "x" * 50_000, "last\nlines\nhere"]
    rows = [(n if n else None, t, "en", "s", 1, *[f"{n}{c}" for c in names]) for n, t in enumerate([*texts, texts[0]])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        own = {tuple(r[c] for c in names) for r in docs.collect()}
        kept = [c for c in result.columns if c in names]
        if number < 4:
            assert result.columns == docs.columns
            assert {tuple(r[c] for c in names) for r in result.collect()} <= own
        else:
            assert set(kept) == set(names) and result.count() == docs.count()
        docs = corpus_pipeline.written(result, f"clash{number}") if number < 4 else result
