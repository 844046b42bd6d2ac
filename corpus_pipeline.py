"""From raw documents to token ids: quality, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet into the shared folder and
reads it again for the next one, so a lost executor never reaches back beyond a stage.

Further columns of any name and type come through unread. A null text has no lines, shingles, words or tokens; it
is scored as an empty text. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centsible.llm import decontaminate, linededup, ngramjoin, quality
from centsible.llm.frames import brought_back, set_aside, table, written
from centsible.llm.settings import LEAST_QUALITY, quality_model, token_digests

USED = ("doc_id", "text")
#: Of a shorter line one word is too large a part to call two lines near; it goes only if it is repeated.
LEAST_WORDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(set_aside(docs, *USED), model).where(F.col("score") >= LEAST_QUALITY)
    return scored.select(*brought_back(scored, docs, *USED))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier (up to one word) go, and documents that had lines and keep none."""
    cut = linededup.dedup_lines(set_aside(docs, *USED), LEAST_WORDS)
    kept = cut.where((F.col("n_lines") == 0) | (F.col("n_lines") > F.size("dropped")))
    columns = brought_back(kept, docs, *USED)
    length = F.length("text").cast("long").alias("n_chars")
    return kept.select(*[length if name == "n_chars" else c for name, c in zip(docs.columns, columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their shingles, the one with the lowest id stays."""
    return ngramjoin.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which benchmark phrases cover a twentieth of the words or more."""
    found = decontaminate.find_contamination(set_aside(docs, *USED), table(spark, sf_dir, "benchmark"))
    bad = decontaminate.is_contaminated(decontaminate.n_hit(F.col("spans")), F.col("n_words"))
    clean = found.where(~bad)
    return clean.select(*brought_back(clean, docs, *USED))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return token_digests(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: No SQL: the classifier's weights and the merges of the vocabulary are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage{number}")
    return docs
