"""Manifest, key index and merging of stored parts."""

import shutil
from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from centsible.operators import rollup as ro
from centsible.plans import transactions as pt
from centsible.schemas import TRANSACTION_SCHEMA
from centsible.sources import keys as K
from centsible.sources.manifest import Manifest, Part, names_in
from centsible.sources.tables import IDS, Store
from centsible.streaming import ingest
from tests.conftest import AS_OF


def rows_of(make, *ids, **fields):
    rows = make(*[{"source_id": i, **fields} for i in ids])
    return rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else F.lit({"category_id": 3, "transacted_date": date(2024, 3, 15), "created_at": AS_OF}.get(f.name)).cast(f.dataType).alias(f.name)
            for f in TRANSACTION_SCHEMA
        ]
    )


def ids(df):
    return sorted(r.source_id for r in df.collect())


def test_only_what_is_committed_is_read(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.put_transactions(rows_of(make, "a"), 0)
    store.put_transactions(rows_of(make, "lost attempt"), 0)
    assert store.transactions().count() == 0
    store.manifest.commit([first])
    assert ids(store.transactions()) == ["a"]
    store.write_transactions(rows_of(make, "b"), 0)  # the batch again
    assert ids(store.transactions()) == ["b"]


def test_a_committed_part_that_is_gone_fails(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch_id in range(3):
        store.write_transactions(rows_of(make, f"k{batch_id}"), batch_id)
    store.compact_transactions(1)
    for part in store.parts("transactions"):
        keep = tmp_path / "kept"
        shutil.copytree(store.path(part.path), keep)
        shutil.rmtree(store.path(part.path))
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            store.transactions().count()
        shutil.copytree(keep, store.path(part.path))
        shutil.rmtree(keep)
    assert ids(store.transactions()) == ["k0", "k1", "k2"]


def test_an_unfinished_version_is_not_read_and_is_written_again(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    manifest.commit([Part("t", "t/a", 0, 0, 0)])
    (tmp_path / "manifest" / "version=2" / "_temporary").mkdir(parents=True)
    assert manifest.newest() == (1, [Part("t", "t/a", 0, 0, 0)])
    manifest.commit([Part("t", "t/b", 0, 1, 1)])
    assert manifest.newest()[0] == 2 and len(manifest.newest()[1]) == 2


def test_a_part_cannot_be_dropped_twice(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    with pytest.raises(ValueError):
        manifest.commit([], drop=[Part("t", "t/a", 0, 0, 0)])


def test_parts_and_folders_stay_few_over_a_hundred_batches(spark, make, tmp_path):
    store = Store(spark, str(tmp_path), fan=4, keep=3)
    rows = rows_of(make, "a").coalesce(1).persist()
    for batch_id in range(100):
        part = store.put("outcomes", rows.selectExpr("source_type", "'ACCEPTED' AS outcome", f"{batch_id}L AS records", f"{batch_id}L AS batch_id"), batch_id)
        store.manifest.commit([part])
        store.merge(batch_id, "outcomes")
    assert sorted(r.records for r in store.outcomes().collect()) == list(range(100))
    parts = store.parts("outcomes")
    assert len(parts) <= 16 and max(p.level for p in parts) >= 3
    assert len(names_in(spark, store.path("outcomes"))) <= len(parts) + 4 * 3
    assert len(store.manifest.versions()) <= 3


def test_merged_days_get_folders_once_they_are_large(spark, make, tmp_path):
    small, large = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "l"), day_bytes=1)
    for store in (small, large):
        for batch_id in range(2):
            store.write_transactions(rows_of(make, f"k{batch_id}", merchant_name=f"m{batch_id}"), batch_id)
        store.compact_transactions(1)
        store.write_transactions(rows_of(make, "k2"), 2)
        assert ids(store.transactions()) == ["k0", "k1", "k2"]
    assert [p.key for p in small.parts("transactions")] == [None, None]
    assert sorted(p.key or "" for p in large.parts("transactions")) == ["", "day"]
    plan = large.transactions().where("transacted_date = '2024-03-15'")._jdf.queryExecution().executedPlan().toString()
    assert any("transacted_date" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_untouched_months_keep_their_files(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))

    def part(batch_id, *days):
        rows = [rows_of(make, f"k{batch_id}-{n}", amount=Decimal(10)).withColumn("transacted_at", F.lit(day).cast("timestamp")) for n, day in enumerate(days)]
        both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        store.write_rollup_part(ro.daily_rollup(both), batch_id)

    part(0, "2024-01-10", "2024-02-10")
    store.compact_rollup(0)
    before = {p.key: p.path for p in store.parts("rollup_base")}
    assert set(before) == {"2024-01", "2024-02"}
    part(1, "2024-02-11")
    part(2, "2024-04-02")
    store.compact_rollup(2)
    after = {p.key: p.path for p in store.parts("rollup_base")}
    assert after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"] and "2024-04" in after
    assert store.parts("rollup_parts") == []
    months = {str(r.period_date): r.total_spend for r in store.rollup(("MONTHLY",)).collect()}
    assert months == {"2024-01-01": 10, "2024-02-01": 20, "2024-04-01": 10}


@pytest.fixture
def index(spark, tmp_path):
    """Three parts of 400 keys each, and a stored table of keys to ask for."""
    paths = []
    for n in range(3):
        rows = spark.range(400 * n, 400 * (n + 1)).selectExpr("concat('k', id) AS key", "current_timestamp() AS seen_at")
        paths.append(str(tmp_path / f"part{n}"))
        K.write_keys(rows, paths[-1], 0, 8)

    def asked(low, high):
        path = str(tmp_path / f"asked{low}-{high}")
        spark.range(low, high).selectExpr("concat('k', id) AS key").write.mode("overwrite").parquet(path)
        return spark.read.schema("key string").parquet(path)

    return paths, asked


@pytest.mark.parametrize("few", [0, 10_000])
def test_known_keys(spark, index, tmp_path, few, monkeypatch):
    paths, asked = index
    monkeypatch.setattr(K, "FEW", few)
    found = K.known_keys(asked(1100, 1300), {0: paths}, 8)
    assert sorted(r.key for r in found.collect()) == sorted(f"k{n}" for n in range(1100, 1200))
    merged = str(tmp_path / "merged")
    K.merge_keys(spark, paths[:2], merged, 0, 8)
    found = K.known_keys(asked(700, 900), {1: [merged], 0: paths[2:]}, 8)
    assert sorted(r.key for r in found.collect()) == sorted(f"k{n}" for n in range(700, 900))
    assert K.known_keys(asked(0, 5), {}, 8).count() == 0


def test_only_the_batch_is_shuffled_and_few_keys_read_their_buckets(spark, index):
    paths, asked = index
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        with K.opened(spark, paths, 0, 8) as rows:
            plan = rows.select("key").join(asked(0, 50), "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            merge = rows.groupBy("key").agg(F.max("seen_at"))._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in merge
            one = rows.where(F.col("key").isin(["k7"]))
            assert one.count() == 1 and one.select(F.input_file_name()).distinct().count() == 1
    finally:
        spark.conf.set(threshold, before)


def test_a_batch_does_not_read_the_stored_transactions(spark, categories, make, tmp_path):
    """Ids are looked up in their index: the stored rows may be gone."""
    store = Store(spark, str(tmp_path))
    for batch_id in range(4):
        ingest.process_batch(make({"source_id": f"k{batch_id}"}), batch_id, store, categories, as_of=AS_OF)
    assert len(store.parts(IDS)) == 4
    for part in store.parts("transactions"):
        shutil.rmtree(store.path(part.path))
    ingest.process_batch(make({"source_id": "k0"}, {"source_id": "k3"}, {"source_id": "new"}), 4, store, categories, as_of=AS_OF)
    outcomes = {r.outcome: r.records for r in store.outcomes().where("batch_id = 4").collect()}
    assert outcomes == {"ACCEPTED": 1, "DUPLICATE": 2, "FAILED": 0}


def test_payloads_are_parsed_once(spark, make, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = make({"raw_payload": '{"city":"Paarl","n":{"k":3}}'}, {"raw_payload": "{}"}, {"raw_payload": "no json"}, {"raw_payload": None})
    store.manifest.commit([store.put_payloads(rows, 0)])
    found = pt.stored_payload_fields(store.payloads(), city="$.city", k="$.n.k", n="$.n")
    got = {r.source_id: (r.city, r.k, r.n) for r in found.collect()}
    assert got == {"id-0": ("Paarl", "3", '{"k":3}'), "id-1": (None,) * 3, "id-2": (None,) * 3, "id-3": (None,) * 3}
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()


NAMES = ["Corner Ring Shop", "string theory", "RING", "rin", "ri ng", "", "ÉRING", "ring ring", "x%y_z", None]


@pytest.mark.parametrize("term", ["ring", "RING ", "ri", "", "ng r", "%y", "nowhere", "érin"])
@pytest.mark.parametrize("few", [0, 200])
def test_search_by_trigrams(spark, categories, make, tmp_path, term, few, monkeypatch):
    monkeypatch.setattr(pt, "FEW_NAMES", few)
    store = Store(spark, str(tmp_path), fan=2)
    for batch_id in range(2):
        rows = make(*[{"source_id": f"{batch_id}-{n}", "merchant_name": name} for n, name in enumerate(NAMES)])
        store.manifest.commit([store.put_merchants(rows, batch_id)])
    store.merge(2, "merchant_grams")
    assert [p.level for p in store.parts("merchant_grams")] == [1]
    found = sorted(r.merchant_name for r in store.merchants_with(term).collect())
    assert found == sorted(n for n in NAMES if n is not None and term.lower() in n.lower())
    facts = rows_of(make, "a", merchant_name="a ring b").unionByName(rows_of(make, "b", merchant_name="RING"))
    page = pt.merchant_search(facts, categories, term, names=store.merchants_with(term))
    assert [r.source_id for r in page.data.collect()] == (["b"] if term.lower() in "ring" else [])
