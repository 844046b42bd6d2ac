"""Category assignment in tiers: merchant code, then keyword, then model, then fallback.

No tier shuffles the transactions while the dimension is small: the merchant codes are an equi-join side that Spark
broadcasts after checking its size, up to ``COMPILED_KEYWORDS`` keywords are branches of one expression, and up to
``FEW_KEYWORDS`` travel as one array value. More keywords are looked up once per merchant name, by an equi-join of the name's
windows of the keywords' lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.functions.text import is_blank
from centsible.schemas import FALLBACK_CATEGORY

# Adds ml_code (string, null = no answer) and ml_confidence (double) to unmatched rows.
Classifier = Callable[[DataFrame], DataFrame]

ML_ERROR = "ml_error"

#: So many keywords are tried one after the other on each name.
FEW_KEYWORDS = 500
#: So many are compiled into the plan; a longer expression would no longer be compiled to machine code.
COMPILED_KEYWORDS = 32

RULES = "rules"
ML = "ml"
FALLBACK = "fallback"


def mcc_rules(categories: DataFrame) -> DataFrame:
    """One row per merchant code; if several categories list a code the lowest id has it."""
    return (
        categories.select(F.explode("mcc_codes").alias("merchant_mcc"), "id")
        .groupBy("merchant_mcc")
        .agg(F.min("id").alias("mcc_category_id"))
    )


def match_mcc(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``mcc_category_id``: exact membership of the code in a category's list."""
    return transactions.join(mcc_rules(categories), "merchant_mcc", "left")


def keyword_pairs(categories: DataFrame) -> DataFrame:
    """id, keyword: every keyword in small letters, with its category."""
    keyword = F.lower(F.btrim("keyword"))
    exploded = categories.select("id", F.explode("keywords").alias("keyword")).where(f"NOT {is_blank('keyword')}")
    return exploded.select("id", keyword.alias("keyword"))


def keyword_rules(categories: DataFrame) -> Column:
    """All keywords with their category id, as one array (a scalar subquery run once). For few keywords."""
    return keyword_pairs(categories).agg(F.collect_list(F.struct("id", "keyword"))).scalar()


def keyword_category(merchant_name: Column, rules: Column) -> Column:
    """Lowest id of the categories with a keyword inside the merchant name, in any case."""
    name = F.lower(merchant_name)
    hits = F.filter(rules, lambda rule: F.contains(name, rule["keyword"]))
    return F.array_min(F.transform(hits, lambda rule: rule["id"]))


def compiled_category(merchant_name: Column, pairs: list[tuple[int, str]]) -> Column:
    """The same for very few keywords (id, keyword), which are tried by rising id without a lambda, so Spark compiles it."""
    name, found = F.lower(merchant_name), F.lit(None).cast("bigint")
    for number, keyword in sorted(pairs, reverse=True):
        found = F.when(F.contains(name, F.lit(keyword)), F.lit(number).cast("bigint")).otherwise(found)
    return found


def few_keywords(categories: DataFrame) -> list[tuple[int, str]] | None:
    """The keywords (id, keyword), if there are no more than ``FEW_KEYWORDS``."""
    rows = keyword_pairs(categories).where("id IS NOT NULL").limit(FEW_KEYWORDS + 1).collect()
    return [(r.id, r.keyword) for r in rows] if len(rows) <= FEW_KEYWORDS else None


def with_keyword_category(transactions: DataFrame, categories: DataFrame, pairs: list[tuple[int, str]], column: str, before: Column | None = None) -> DataFrame:
    """Add ``column``: the category by few keywords, or ``before`` where that is known, and no keyword is looked at."""
    first = [] if before is None else [before]
    if len(pairs) <= COMPILED_KEYWORDS:
        return transactions.withColumn(column, F.coalesce(*first, compiled_category(F.col("merchant_name"), pairs)))
    ruled = transactions.withColumn("_rules", keyword_rules(categories))
    return ruled.withColumn(column, F.coalesce(*first, keyword_category(F.col("merchant_name"), F.col("_rules")))).drop("_rules")


def merchant_categories(merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """merchant_name, keyword_category_id of the names that hold a keyword, for keywords of any number.

    Every distinct name is cut into its windows of the lengths that keywords have, and windows and keywords are joined:
    the work follows the names' lengths, not the number of keywords. Hot names are one row here.
    """
    pairs = keyword_pairs(categories).groupBy("keyword").agg(F.min("id").alias("id"))
    lengths = [r.n for r in pairs.select(F.char_length("keyword").alias("n")).distinct().collect()]  # small numbers
    names = merchants.select("merchant_name").where("merchant_name IS NOT NULL").distinct()
    names = names.withColumn("name", F.lower("merchant_name"))
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    sized = names.withColumn("size", F.explode(sizes)).where("char_length(name) >= size")
    placed = sized.withColumn("place", F.explode(F.expr("sequence(1, char_length(name) - size + 1)")))
    windows = placed.select("merchant_name", F.expr("substring(name, place, size)").alias("keyword"))
    hits = windows.join(pairs, "keyword")
    return hits.groupBy("merchant_name").agg(F.min("id").alias("keyword_category_id"))


def match_keyword(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``keyword_category_id``."""
    few = few_keywords(categories)
    if few is None:
        return transactions.join(merchant_categories(transactions, categories), "merchant_name", "left")
    return with_keyword_category(transactions, categories, few, "keyword_category_id")


def _fallback_id(categories: DataFrame, strict: bool) -> Column:
    """Id of the fallback category. A dimension without it is misconfigured: that fails the job, or, if not strict,
    leaves the rows that need it without a category."""
    found = categories.where(F.col("code") == FALLBACK_CATEGORY).agg(F.min("id")).scalar()
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.lit(f"no category {FALLBACK_CATEGORY!r}")).cast("bigint"))


def _match_model(unmatched: DataFrame, categories: DataFrame, classifier: Classifier) -> DataFrame:
    """Model answers as category ids; an unknown code is no match."""
    codes = categories.select(F.col("code").alias("ml_code"), F.col("id").alias("ml_category_id"))
    answered = classifier(unmatched)
    if ML_ERROR not in answered.columns:
        answered = answered.withColumn(ML_ERROR, F.lit(None).cast("string"))
    return answered.join(codes, "ml_code", "left").drop("ml_code", "ml_confidence")


def categorise(
    transactions: DataFrame, categories: DataFrame, classifier: Classifier | None = None, strict: bool = True
) -> DataFrame:
    """Add ``category_id`` (never null if strict) and ``category_tier`` (rules / ml / fallback); not strict, also
    ``ml_error``, what the model said to rows it failed on."""
    by_mcc = match_mcc(transactions, categories)
    few = few_keywords(categories)
    if few is None:
        names = by_mcc.where("mcc_category_id IS NULL")
        matched = by_mcc.join(merchant_categories(names, categories), "merchant_name", "left")
        matched = matched.withColumn("rule_id", F.coalesce("mcc_category_id", "keyword_category_id"))
        matched = matched.drop("mcc_category_id", "keyword_category_id")
    else:
        # coalesce stops at the first hit, so keywords are only searched where no code matched
        matched = with_keyword_category(by_mcc, categories, few, "rule_id", F.col("mcc_category_id")).drop("mcc_category_id")
    if classifier is None:
        model_id, error = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    else:
        unmatched = matched.where(F.col("rule_id").isNull())
        rest = matched.where(F.col("rule_id").isNotNull())
        rest = rest.withColumn("ml_category_id", F.lit(None).cast("bigint")).withColumn(ML_ERROR, F.lit(None).cast("string"))
        matched = _match_model(unmatched, categories, classifier).unionByName(rest)
        model_id, error = F.col("ml_category_id"), F.col(ML_ERROR)
    tier = F.when(F.col("rule_id").isNotNull(), RULES).when(model_id.isNotNull(), ML).otherwise(FALLBACK)
    return matched.select(
        *transactions.columns,
        F.coalesce(F.col("rule_id"), model_id, _fallback_id(categories, strict)).alias("category_id"),
        tier.alias("category_tier"),
        *([] if strict else [error.alias(ML_ERROR)]),
    )


def with_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Add the category's id, code and label columns to rows that carry ``category_id``."""
    names = categories.select(
        F.col("id").alias("category_id"),
        F.col("external_id").alias("category_external_id"),
        F.col("code").alias("category_code"),
        F.col("label").alias("category_label"),
    )
    return df.join(names, "category_id", "left")


def orphans(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose category id is not in the dimension (there should be none)."""
    return df.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti")


def category_paths(categories: DataFrame) -> DataFrame:
    """Categories with ``path``, the codes from the root down, and ``depth``, for a tree of any depth.

    A category whose parent is not in the dimension is a root. One that no root leads to hangs on a cycle; that fails
    the job.
    """
    found = categories.sparkSession.sql(
        """WITH RECURSIVE nodes AS (
            SELECT c.id, c.code, p.id AS parent FROM {categories} c LEFT JOIN {categories} p ON c.parent_id = p.id),
        tree(id, path, depth) AS (
            SELECT id, code, 1 FROM nodes WHERE parent IS NULL
            UNION ALL SELECT n.id, concat(t.path, '.', n.code), t.depth + 1 FROM nodes n JOIN tree t ON n.parent = t.id)
        SELECT id AS node, path, depth FROM tree""",
        categories=categories,
    )
    others = categories.drop("path", "depth")
    joined = others.join(found, others["id"] == found["node"], "left").drop("node")
    cycle = F.raise_error(F.concat(F.lit("category without a root: "), F.col("code"))).cast("string")
    return joined.withColumn("path", F.coalesce("path", cycle))


def with_parent(categories: DataFrame) -> DataFrame:
    """Category tree: each category with its parent and its depth in the dotted path."""
    parent = categories.select(
        F.col("id").alias("parent_id"),
        F.col("code").alias("parent_code"),
        F.col("label").alias("parent_label"),
    )
    return categories.join(parent, "parent_id", "left").withColumn(
        "depth", F.size(F.split("path", r"\."))
    )
