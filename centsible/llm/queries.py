"""The corpus queries: each operator over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from centsible.llm import (
    decontaminate,
    fingerprints,
    langid,
    licenses,
    linededup,
    ngramjoin,
    quality,
    secrets,
    sharding,
    spelling,
    sql,
    urls,
    vectorcodes,
)
from centsible.llm.frames import table
from centsible.llm.settings import LEAST_QUALITY, quality_model, sha256, token_digests

# fixed values: host, path and verdict of the rules of the URL query
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

def op1_ngram_join(spark, sf_dir):
    found = ngramjoin.shingle_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op1_ngram_links(spark, sf_dir):
    found = ngramjoin.link_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "cls", "n_links")


def op2_decontaminate(spark, sf_dir):
    docs, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.find_contamination(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    found = found.withColumn("n_hit", decontaminate.n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.is_held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"),
        "n_passages",
        "top_passage",
    )


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = quality.is_held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held_out))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_fingerprint(spark, sf_dir):
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark, sf_dir):
    judged = linededup.with_decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = lambda d: F.concat_ws(":", *(d[n].cast("string") for n in ("line", "first_doc_id", "first_line", "distance")))
    return judged.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("dropped", one), ",").alias("dropped"),
    )


def op8_rendezvous_shards(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    return placed.withColumn("law", F.lit("key"))


def op9_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = secrets.with_kinds(F.col("found"), [rule.kind for rule in secrets.BASE_RULES])
    count = lambda kind: F.size(secrets.with_kinds(F.col("found"), [kind])).cast("long")
    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("found")).alias("spans"),
    )


def op11_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = licenses.phrases_of(F.col("spans"))
    words = F.transform(base, lambda s: s["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        licenses.labels_text(base).alias("base_labels"),
        licenses.labels_text(F.col("spans")).alias("labels"),
        licenses.likeness(F.col("spans")).alias("score"),
    )


def op12_vector_codes(spark, sf_dir):
    rows, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    summed = vectorcodes.with_label_error(rows)
    return summed.select(
        "vec_id",
        vectorcodes.code_text(F.col("codes")).alias("code"),
        "error",
        "label_error",
        F.sha2(F.lit(vectorcodes.codebook_text(books)), 256).alias("codebooks_sha256"),
    )


def op13_spelling(spark, sf_dir):
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    function.__name__: function
    for function in (
        op1_ngram_join,
        op1_ngram_links,
        op2_decontaminate,
        op3_quality,
        op4_language,
        op5_fingerprint,
        op6_bpe,
        op7_line_dedup,
        op8_rendezvous_shards,
        op9_url_filter,
        op10_secret_scan,
        op11_license_scan,
        op12_vector_codes,
        op13_spelling,
    )
}
SQL = dict(sql.SQL)
