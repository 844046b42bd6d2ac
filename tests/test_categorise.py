import pandas as pd
import pytest
from pyspark.sql import functions as F

from centsible.operators import categorise as cg
from centsible.operators import classify
from centsible.sources.categories import load_categories, read_categories, write_categories


def assigned(make, categories, classifier=None, **record):
    row = cg.with_category(cg.categorise(make(record), categories, classifier), categories).first()
    return row.category_code, row.category_tier


@pytest.mark.parametrize(
    "merchant, mcc, expected",
    [
        ("Test Supermarket", "5411", ("groceries", "rules")),
        ("Pizza Place", "5411", ("groceries", "rules")),
        ("Pizza Place", None, ("food_and_dining", "rules")),
        ("Restaurant Roma", None, ("food_and_dining", "rules")),
        ("KFC Main Road", None, ("restaurants", "rules")),
        ("Training Ltd", None, ("telecoms", "rules")),
        ("STARBUCKS COFFEE", None, ("food_and_dining", "rules")),
        ("PICK N PAY Cape Town", None, ("groceries", "rules")),
        ("Payment to Mr Price Online", None, ("clothing", "rules")),
        ("Zzz", "541", ("uncategorised", "fallback")),
        ("Zzz", "9999", ("uncategorised", "fallback")),
        ("Zzz", " ", ("uncategorised", "fallback")),
        ("Netflix", "9999", ("entertainment", "rules")),
    ],
)
def test_rules(make, categories, merchant, mcc, expected):
    assert assigned(make, categories, merchant_name=merchant, merchant_mcc=mcc) == expected


def test_lowest_id_wins_and_blank_keywords_match_nothing(make, spark):
    rows = [
        (1, "a", "A", None, "5000", "foo, ,"),
        (2, "b", "B", None, "5000, 5001", "foo,bar"),
        (3, "uncategorised", "U", None, None, None),
    ]
    dim = load_categories(spark, rows)
    assert assigned(make, dim, merchant_name="x", merchant_mcc="5000") == ("a", "rules")
    assert assigned(make, dim, merchant_name="x", merchant_mcc="5001") == ("b", "rules")
    assert assigned(make, dim, merchant_name="FOO") == ("a", "rules")
    assert assigned(make, dim, merchant_name="qqq") == ("uncategorised", "fallback")


def test_python_classifier_answers_only_unmatched_rows(make, categories):
    def predict(requests: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "code": requests["merchant_name"].map({"Known": "travel", "Odd": "no_such_code"}),
                "confidence": 0.5,
            }
        )

    model = classify.python_classifier(predict)
    assert assigned(make, categories, model, merchant_name="Known") == ("travel", "ml")
    assert assigned(make, categories, model, merchant_name="Odd") == ("uncategorised", "fallback")
    assert assigned(make, categories, model, merchant_name="Other") == ("uncategorised", "fallback")
    assert assigned(make, categories, model, merchant_name="Netflix") == ("entertainment", "rules")


def test_failing_classifier_means_no_match(make, categories):
    def predict(requests):
        raise RuntimeError("model is down")

    model = classify.python_classifier(predict)
    assert assigned(make, categories, model, merchant_name="Known") == ("uncategorised", "fallback")


def test_a_model_that_fails_on_one_row_answers_the_others(make, categories):
    def predict(requests):
        if (requests["merchant_name"] == "poison").any():
            raise ValueError("cannot read this")
        return pd.DataFrame({"code": ["travel"] * len(requests), "confidence": 0.5})

    names = [f"nobody {n}" for n in range(9)] + ["poison"] * 2
    rows = make(*[{"merchant_name": name} for name in names]).coalesce(1)
    found = cg.categorise(rows, categories, classify.python_classifier(predict), strict=False)
    got = sorted((r.merchant_name, r.category_tier, r.ml_error) for r in found.collect())
    assert got == sorted([(f"nobody {n}", "ml", None) for n in range(9)] + [("poison", "fallback", "ValueError: cannot read this")] * 2)


def test_text_model_learns_from_rules(make, categories):
    rows = [{"merchant_name": f"{w} pizza corner"} for w in ("red", "blue", "green")]
    rows += [{"merchant_name": f"{w} hotel tower"} for w in ("red", "blue", "green")]
    labelled = cg.with_category(cg.categorise(make(*rows), categories), categories)
    model = classify.model_classifier(classify.fit_text_model(labelled))
    assert assigned(make, categories, model, merchant_name="Corner") == ("food_and_dining", "ml")
    assert assigned(make, categories, model, merchant_name="Tower") == ("travel", "ml")
    picky = classify.model_classifier(classify.fit_text_model(labelled), min_confidence=0.999)
    assert assigned(make, categories, picky, merchant_name="Corner") == ("uncategorised", "fallback")


def test_facts_are_not_shuffled(make, categories):
    plan = cg.categorise(make({}), categories)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_seed_and_tree(categories, spark, tmp_path):
    assert categories.count() == 19
    tree = {r.code: r for r in cg.with_parent(categories).collect()}
    assert tree["groceries"].path == "food_and_dining.groceries"
    assert (tree["groceries"].parent_code, tree["groceries"].depth) == ("food_and_dining", 2)
    assert (tree["travel"].parent_code, tree["travel"].depth) == (None, 1)
    assert tree["uncategorised"].keywords is None
    write_categories(categories, str(tmp_path / "c"))
    back = read_categories(spark, str(tmp_path / "c"))
    assert back.where("code = 'fuel'").first().mcc_codes == ["5541", "5542", "5172"]


def test_orphans(make, categories):
    rows = cg.categorise(make({}, {}), categories).withColumn(
        "category_id", F.when(F.col("source_id") == "id-0", 77).otherwise(F.col("category_id")).cast("bigint")
    )
    assert [r.source_id for r in cg.orphans(rows, categories).collect()] == ["id-0"]


def test_a_hundred_thousand_keywords(spark, make):
    """Names are cut once each and joined; no list of keywords is tried on a row."""
    keywords = [(n, f"Key{n}Word{n}") for n in range(100_000)]
    dimension = spark.createDataFrame(keywords, "id long, keyword string").groupBy((F.col("id") % 50 + 1).alias("id")).agg(F.collect_list("keyword").alias("keywords"))
    names = ["a key77word77 shop", "KEY5WORD5 and key3word3", "key1word", "", None, "x" * 3000 + "key99999word99999", "a KEY77word77 shop"]
    rows = make(*[{"merchant_name": n} for n in names * 3])
    found = cg.match_keyword(rows, dimension)
    got = {r.merchant_name: r.keyword_category_id for r in found.collect()}
    assert found.count() == 21
    # key77word77 holds no other keyword than itself: 77 % 50 + 1; the lowest of two wins
    assert got == {names[0]: 28, names[1]: 4, names[2]: None, "": None, None: None, names[5]: 50, names[6]: 28}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct" not in plan and "scalar-subquery" not in plan


@pytest.mark.parametrize("few", [0, 500])
def test_keywords_either_way(make, categories, few, monkeypatch):
    monkeypatch.setattr(cg, "FEW_KEYWORDS", few)
    names = ["Netflix", "WOOLWORTHS pharmacy", "apple music", "nothing", None, "Uber Eats", "booking.com flight"]
    rows = make(*[{"merchant_name": n, "merchant_mcc": m} for n in names for m in (None, "5411")])
    expected = {n: min([c.id for c in categories.collect() for k in c.keywords or [] if n and k in n.lower()], default=None) for n in names}
    assert {r.merchant_name: r.keyword_category_id for r in cg.match_keyword(rows, categories).collect()} == expected
    by_name = {(r.merchant_name, r.merchant_mcc): r.category_id for r in cg.categorise(rows, categories).collect()}
    assert all(by_name[n, None] == (expected[n] or 19) for n in names) and len({by_name[n, "5411"] for n in names}) == 1


def test_paths_of_a_tree_of_any_depth(spark):
    rows = [(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 3), (5, "e", 99)]
    tree = spark.createDataFrame(rows, "id long, code string, parent_id long")
    assert {r.code: (r.path, r.depth) for r in cg.category_paths(tree).collect()} == {
        "a": ("a", 1), "b": ("a.b", 2), "c": ("a.b.c", 3), "d": ("a.b.c.d", 4), "e": ("e", 1)
    }
    loaded = load_categories(spark, [(i, c, c.upper(), p, None, None) for i, c, p in rows])
    assert {r.code: r.path for r in loaded.collect()} == {"a": "a", "b": "a.b", "c": "a.b.c", "d": "a.b.c.d", "e": "e"}


def test_parents_in_a_circle(spark):
    rows = [(1, "a", 2), (2, "b", 1), (3, "c", None)]
    with pytest.raises(ValueError, match="circle"):
        load_categories(spark, [(i, c, c, p, None, None) for i, c, p in rows])
    with pytest.raises(Exception, match="without a root"):
        cg.category_paths(spark.createDataFrame(rows, "id long, code string, parent_id long")).collect()
