from __future__ import annotations

import numpy as np

from centsible.llm import bloom, urls

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("Example.org", "/en/1", "block"),
    ("com", "", "block"),
    ("a.com", "/x", "allow"),
    ("org", "/", "allow"),
    ("a", "b", "block"),
    ("ne", "t/", "block"),
    ("x.net", "", "block"),
]
URLS = [
    "http://a.Example.org/es/1",
    "http://notexample.org/es/1",
    "https://example.org/en/12?x=1",
    "https://example.org/en/2#top",
    "ftp://B.A.COM/xyz",
    "http://b.a.com",
    "http://aa.com/x",
    "example.org/es/",
    "http://",
    "://org/?",
    "http://org",
    "",
    None,
    "http://é.org/ö",
    "http://net.org:80/es/",
    "a://b://org/",
    "http://ab",
    "http://x.ab/",
    "http://a/b",
    "http://net/",
    "http://y.x.net",
    "http://" + "a." * 500 + "com/" + "p" * 5000,
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in ((h.lower(), p, v) for h, p, v in RULES)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[2] if best else "allow"


def test_verdicts_equal_plain_matching(spark):
    rows = [(n, url, "clash") for n, url in enumerate(URLS)] + [(0, URLS[0], "again")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in urls.judge_urls(pages, rules).collect())
    assert sorted(map(str, got)) == sorted(str((n, *by_hand(url))) for n, url, _ in rows)


def test_long_list_and_small_filter(spark):
    """False positives of a filter that is far too small change nothing."""
    rules = spark.range(3000).selectExpr("concat('h', id, '.net') AS host", "'/' AS path", "'block' AS verdict")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '.net/') AS url")
    held = bloom.BloomFilter.build(rules.selectExpr("xxhash64(host, path)"))
    assert 0 < held.blocks.nbytes <= 3000 * bloom.BITS_PER_KEY
    got = urls.judge_urls(pages, rules).collect()
    assert all((r.verdict == "block") == (r.page_id < 3000) for r in got) and len(got) == 6000


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(4000).selectExpr("cast(id AS string) AS k")
    held = bloom.BloomFilter.build(keys.selectExpr("xxhash64(k)"))
    probe = spark.range(8000).selectExpr("id", "xxhash64(cast(id AS string)) AS h").toPandas()
    found = held.may_hold(probe.h.to_numpy())
    assert found[probe.id < 4000].all() and found[probe.id >= 4000].mean() < 0.02
    crowded = bloom.BloomFilter.build(keys.selectExpr("xxhash64(k)"), max_bytes=32)
    assert len(crowded.blocks) == 1 and crowded.may_hold(np.asarray(probe.h))[probe.id < 4000].all()


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge_urls(one, rules).collect()] == [(1, "x.org", "/", None, "allow")]


def test_one_page_for_a_third_of_the_table(spark):
    """Copies stay rows all the way: none is rebuilt from a count."""
    pages = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://a.com/x' ELSE concat('http://h', id, '.net/') END AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(pages, rules)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Generate" not in plan
    got = judged.collect()
    assert len(got) == 3000 and sum(r.page_id == 7 and r.rule == "a.com/x" for r in got) == 1000
