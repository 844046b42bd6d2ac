from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
import xxhash

from centsible.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_rendezvous_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 8 and max(map(len, slots.values())) < 1.4 * len(docs) / 8
    assert 0.05 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.18


def test_hot_and_null_keys_and_clashing_names(spark):
    rows = [(7, "same", 1, 2)] * 300 + [(None, None, 1, 2)] * 5 + [(n, "", 1, 2) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, shard int").repartition(3)
    placed = sharding.assign_shards(docs, [1.0, 2.0, 4.0]).collect()
    assert len(placed) == len(rows)
    slots = {}
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in placed if r.doc_id == 7}) == 1
    assert {r["size"] for r in placed if r.doc_id is None} == {1}


def test_weights_decide_the_shares(spark):
    keys = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    share = Counter(r.shard for r in sharding.assign_shards(keys, [1.0, 3.0]).collect())
    assert 0.72 < share[1] / 6000 < 0.78


def test_growing_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text")
    old = {r.doc_id: r.shard for r in sharding.assign_shards(keys, [1.0, 2.0]).collect()}
    new = {r.doc_id: r.shard for r in sharding.assign_shards(keys, [1.0, 2.0, 1.5]).collect()}
    assert all(new[k] in (old[k], 2) for k in old)


def test_empty_and_bad_weights(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [1.0, 0.0])


def winner(key, weights):
    """The shard with the least draw, one after the other."""
    draws = []
    for shard, weight in enumerate(weights):
        seed = xxhash.xxh64_intdigest(key.encode(), 42)
        number = xxhash.xxh64_intdigest(f"shard {shard}".encode(), seed)
        draws.append((-math.log(((number >> 11) + 0.5) / 2.0**53) / weight, shard))
    return min(draws)[1]


def test_every_row_goes_to_the_shard_that_wins_its_key(spark):
    got = queries.op8_rendezvous_shards(spark, SF).collect()
    assert got and all(r.shard == winner(str(r.doc_id), [1.0] * 8) for r in got)
    assert all(r.grown_shard == winner(str(r.doc_id), [1.0] * 9) for r in got)
    weights = [0.5, 3.0, 1.25]
    keys = spark.createDataFrame([(n, "t") for n in range(300)] + [(None, "t")], "doc_id long, text string")
    placed = sharding.assign_shards(keys, weights).collect()
    assert all(r.shard == winner("null" if r.doc_id is None else str(r.doc_id), weights) for r in placed)


def test_very_long_text(spark):
    text = "é" * 3_000_000
    (row,) = sharding.assign_shards(spark.createDataFrame([(1, text)], "doc_id long, text string"), [1.0, 1.0]).collect()
    assert (row["size"], row.text_crc32, row.slot) == (6_000_001, zlib.crc32(text.encode()), 0)
