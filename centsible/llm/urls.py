"""URL rules: a blocked Bloom filter of the listed URLs in front of an exact hash join.

A rule is a host and a path prefix with a verdict. It fits its host and all subdomains if the path of
the URL starts with the rule's; the longest rule (host and path together, then host, then block before
allow) wins. The listed canonical URLs are the rules' pairs of host and path. Each URL asks for
the few listed pairs it could match; the filter answers "surely not listed" for most of them, and only
possible hits go into the join, which removes false positives.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule with a host;
repeated rows are all given back; an empty rule list leaves every URL
with the default verdict; an empty table gives no rows; rules that repeat count once; a rule with a null host or
verdict raises. Other columns of the pages are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.llm.bloom import BloomFilter
from centsible.llm.frames import map_batches, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(authority) + 1), r"^[^?#]*", 0)
    return F.translate(authority, ALPHABET, ALPHABET.lower()), path


def _listed_forms(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """Every (host, path) that a fitting rule could have, of the sizes that rules do have."""
    labels = F.split(host, r"\.")
    hosts = [
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - F.lit(n - 1), n), "."))
        for n in label_counts
    ]
    paths = [F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in path_lengths]
    pairs = [F.when(h.isNotNull() & p.isNotNull(), F.struct(h.alias("h"), p.alias("p"))) for h in hosts for p in paths]
    return F.array_compact(F.array(*pairs))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``rules``: host, path, verdict."""
    bad = F.col("host").isNull() | F.col("verdict").isNull() | ~F.col("verdict").isin("allow", "block")
    rules = rules.select(
        F.when(bad, F.raise_error(F.lit("a rule needs a host and a verdict of allow or block")))
        .otherwise(F.translate("host", ALPHABET, ALPHABET.lower()))
        .alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    )
    listed = rules.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        F.col("verdict").alias("rule_verdict"),
    ).dropDuplicates()
    sizes = listed.agg(F.collect_set("labels"), F.collect_set("path_length")).first()  # a few small numbers
    label_counts, path_lengths = sorted(sizes[0]), sorted(sizes[1])

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if label_counts:
        forms = _listed_forms(F.col("host"), F.col("path"), label_counts, path_lengths)
    else:
        forms = F.array().cast("array<struct<h: string, p: string>>")
    asked = rows.withColumn("hashes", F.transform(forms, lambda f: F.xxhash64(f["h"], f["p"])))
    held = pages.sparkSession.sparkContext.broadcast(BloomFilter.build(listed.select(F.xxhash64("rule_host", "rule_path"))).blocks)

    def probe(batches):
        bloom = BloomFilter(held.value)
        for batch in batches:
            at = batch.schema.get_field_index
            hashes = batch.column(at("hashes"))
            hit = bloom.may_hold(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            owner = np.repeat(np.arange(batch.num_rows), hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            possible = np.bincount(owner[hit], minlength=batch.num_rows) > 0
            names = ["page_id", "host", "path"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(possible)], [*names, "possible"])

    possible = map_batches(asked, probe, T.StructType([*rows.schema.fields, T.StructField("possible", T.BooleanType())]))
    # a verdict belongs to host and path, so each pair is judged once, however many pages have it
    pairs = possible.where("possible").select("host", "path").distinct()
    fitting = pairs.withColumn("form", F.explode(forms)).select("host", "path", F.col("form.h").alias("rule_host"), F.col("form.p").alias("rule_path"))
    best = F.max(
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"),
            F.length("rule_host").alias("host_length"),
            F.col("rule_verdict").alias("verdict"),
            F.concat("rule_host", "rule_path").alias("rule"),
        )
    )
    judged = fitting.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("best"))
    # there can be about as many pairs as pages, so they are merged and never broadcast; pages that cannot be listed
    # spread by their own hash, and adaptive execution splits the pages of a hot pair
    judged = written(judged.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best"), "judged-urls")
    spread = F.when(F.col("possible"), 0).otherwise(1 + F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 30)))
    same = (F.col("spread") == F.col("of_spread")) & (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    joined = possible.withColumn("spread", spread).join(judged.withColumn("of_spread", F.lit(0).cast("long")).hint("merge"), same, "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
