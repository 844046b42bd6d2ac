"""Substring search over distinct names by trigram postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.functions.text import contains_ignore_case

ALL = ""  # stands for every name


def _grams(text: Column) -> Column:
    """Distinct runs of three characters; none of shorter texts."""
    size = F.char_length(text)
    places = F.when(size >= 3, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda place: F.substr(text, place, F.lit(3))))


def postings(names: DataFrame) -> DataFrame:
    """gram, merchant_name of the distinct names, in small letters; each name also once under ``ALL``."""
    distinct = names.select("merchant_name").where("merchant_name IS NOT NULL").distinct()
    grams = F.concat(F.array(F.lit(ALL)), _grams(F.lower("merchant_name")))
    return distinct.select(F.explode(grams).alias("gram"), "merchant_name")


def names_with(postings: DataFrame, term: str) -> DataFrame:
    """Distinct names that contain the term, in any case. Names that lack a trigram of the term are out by the postings;
    the others are looked at. A term under three characters looks at every name, none twice."""
    wanted = postings.sparkSession.range(1).select(_grams(F.lower(F.lit(term))).alias("grams")).first().grams or [ALL]
    hits = postings.where(F.col("gram").isin(wanted)).groupBy("merchant_name")
    candidates = hits.agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return candidates.where(contains_ignore_case(F.col("merchant_name"), term)).select("merchant_name")
