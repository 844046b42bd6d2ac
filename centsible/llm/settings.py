"""What the queries and the pipeline share: vocabulary file, thresholds, folds, digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.llm import bpe, quality
from centsible.llm.frames import brought_back, set_aside, without

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A document with a lower quality score is rejected.
LEAST_QUALITY = 0.3


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.MilModel | float:
    """Learned from the labelled documents outside the held-out fold."""
    return quality.fit(docs, labels.where(~quality.is_held_out(F.col("doc_id"), 5, 0)))


def token_digests(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, and n_tokens, ids_sha256, decoded_sha256, which replace
    columns of these names."""
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    encoded = bpe.encode(set_aside(docs, "doc_id", "text"), VOCABULARY, decoded="decoded")
    return encoded.select(
        *brought_back(encoded, docs.drop("text"), "doc_id"),
        "n_tokens",
        sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )
