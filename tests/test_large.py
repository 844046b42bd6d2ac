"""What grows with large tables: nothing is evaluated row by row that can be compiled, and whole rows are neither shuffled nor sorted
where their keys will do."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from centsible.operators import categorise as cg
from centsible.operators import dedup, stages, validate
from centsible.session import INGEST_CONF, prepare, scratch_path, setting
from centsible.sources.tables import Store
from centsible.streaming import accepted

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def keyworded(spark, n):
    rows = [(i % 3 + 5, f"Key{i}x") for i in range(n)]
    return spark.createDataFrame(rows, "id long, keyword string").groupBy("id").agg(F.collect_list("keyword").alias("keywords"))


def test_few_keywords_are_compiled(spark, make):
    """the tier is looked at several times on the way to a model, so it must not be interpreted for each row."""
    rows = make(*[{"merchant_name": n} for n in ("a KEY1X shop", "key3x key2x", "key2x", "nothing", "", None)])
    found = cg.match_keyword(rows, keyworded(spark, cg.COMPILED_KEYWORDS))
    assert "lambda" not in plan(found)
    wanted = [6, 5, 7, None, None, None]
    assert [r.keyword_category_id for r in found.orderBy("arrival_seq").collect()] == wanted
    more = cg.match_keyword(rows, keyworded(spark, cg.COMPILED_KEYWORDS + 1))  # too long to be compiled
    assert "lambda" in plan(more)
    assert [r.keyword_category_id for r in more.orderBy("arrival_seq").collect()] == wanted


def test_no_lambda_on_the_way_of_the_ingest(spark, make):
    dimension = entry.tb.categories(spark)
    assert "lambda" not in plan(stages.later_stages(make({}), dimension))


def test_settings_of_the_ingest_are_taken_back(spark):
    fresh, (key, value) = spark.newSession(), next(iter(INGEST_CONF.items()))
    assert all(prepare(fresh).conf.getAll[k] == v for k, v in INGEST_CONF.items())
    assert not set(INGEST_CONF) & set(prepare(fresh, ingest=False).conf.getAll)
    fresh.conf.set(key, "1m")
    for ingest in (True, False):  # one that a user made stays
        assert prepare(fresh, ingest).conf.getAll[key] == "1m"


def test_a_setting_lasts_as_long_as_it_should(spark):
    with pytest.raises(ValueError), setting(spark, WRITERS, "2"):
        assert spark.conf.get(WRITERS) == "2"
        raise ValueError
    assert WRITERS not in spark.conf.getAll
    with setting(spark, WRITERS, "3"), setting(spark, WRITERS, "2"):
        pass
    assert WRITERS not in spark.conf.getAll


def test_first_rows_that_are_stored_whole(spark, make):
    """F4, F5, F6, F8: of many copies, hot keys, equal rows and null keys the same rows as by the window, of which only keys move."""
    keys = ["a", "b", None, "a", "c", None, "b", "a"] + ["hot"] * 500
    rows = make(*[{"source_id": k, "amount": f"{n % 90 + 1}.00"} for n, k in enumerate(keys)])
    rows = rows.withColumn("arrival_seq", F.lit(1000) - F.col("arrival_seq")).repartition(3)
    first = dedup.first_wins_written(rows, "source_id")
    assert "Window" not in plan(first) and "Expand" not in plan(first)
    assert first.columns == rows.columns
    assert sorted(map(str, first.collect())) == sorted(map(str, dedup.first_wins(rows, "source_id").collect()))
    alike = rows.unionByName(rows)  # every place twice
    assert sorted(map(str, dedup.first_wins_written(alike, "source_id").collect())) == sorted(map(str, first.collect()))
    wide = [line for line in first._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(source_id" in line]
    assert wide and "raw_payload" not in "".join(wide)


def test_records_are_landed_unsorted(spark, tmp_path, monkeypatch):
    """both steps by one task that keeps a file open for each, and does not sort what it reads."""
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "CAST(id % 2 AS INT) AS step")
    folders = {f"{tmp_path}/{name}": rows for name in ("a", "b")}
    seen = []
    real = entry.ingest.together

    def together(*jobs):
        seen.append((spark.conf.get(WRITERS), len(jobs)))
        return real(*jobs)

    monkeypatch.setattr(entry.ingest, "together", together)
    entry._land_by_step(folders)
    assert seen == [("2", 2)] and WRITERS not in spark.conf.getAll
    for folder in folders:
        for step in (0, 1):
            assert [r.id for r in spark.read.parquet(f"{folder}/step={step}").collect()] == list(range(step, 1000, 2))


def test_accepted_rows_are_judged_once(make, monkeypatch):
    """what follows the staging reads whether a row is valid, not the rules' columns."""
    rows = make({}, {"amount": "-1.00"}, {"amount": None}).withColumn("record_key", F.when(F.col("arrival_seq") > 0, F.concat(F.lit("evt"), "arrival_seq")))
    staged = accepted.worth_staging(rows, validate.ingest_rules())
    assert [(r.arrival_seq, r._sound) for r in staged.orderBy("arrival_seq").collect()] == [(0, True), (1, False), (2, False)]
    asked = []
    real = accepted.repeats_of
    monkeypatch.setattr(accepted, "repeats_of", lambda valid, *args: asked.append(plan(valid)) or real(valid, *args))
    store = Store(rows.sparkSession, scratch_path(rows.sparkSession, "accepted"))
    accepted.accept_batch(rows.withColumn("seen_at", F.col("ingested_at")), 0, store)
    assert store.accepted().count() == 1
    filters = [line for line in asked[-1].split("\n") if "Filter" in line]
    assert any("_sound" in line for line in filters) and not any("currency" in line for line in filters)


@pytest.mark.parametrize("name", ["stored_by_id", "stored_search", "rollup_incremental"])
def test_queries_that_store_rows_shuffle_none(spark, monkeypatch, name):
    """F4, F6, F8: no window over whole rows on the way to the table."""
    plans, real = [], entry.tb.transactions

    def transactions(*args, **options):
        rows = real(*args, **options)
        plans.append(plan(rows))
        return rows

    monkeypatch.setattr(entry.tb, "transactions", transactions)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").columns
    assert len(plans) == 1 and "Window" not in plans[0]
