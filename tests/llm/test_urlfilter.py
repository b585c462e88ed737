import math

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import urlfilter
from sparkwright.llm.queries import RULES


def listed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_exact_over_its_universe(spark):
    hosts = [f"h{i}.example.{'com' if i % 2 else 'net'}" for i in range(3000)]
    bad = hosts[::17]
    pages = spark.createDataFrame([(i, f"https://{'www.' if i % 3 else ''}{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    out = {r.page_id: r.verdict for r in urlfilter.judge(pages, listed(spark, bad), []).collect()}
    assert all((out[i] == "block") == (h in bad) for i, h in enumerate(hosts))


def test_levels(spark):
    universe = listed(spark, [f"k{i}" for i in range(50_000)])
    keys = listed(spark, [f"k{i}" for i in range(0, 50_000, 50)])
    levels = urlfilter.cascade(universe.withColumn("hit", (F.substring("key", 2, 9).cast("int") % 50 == 0).cast("int")))
    assert len(levels) > 4
    hit = {r.key for r in universe.filter(urlfilter.member(F.col("key"), levels)).collect()}
    assert hit == {r.key for r in keys.collect()}
    assert sum(x.bits for x in levels) < 1000 * (1.4427 * math.log2(50) + 6) + 3000


@pytest.mark.parametrize("max_bits", [1 << 25, 300])
def test_shards(spark, max_bits):
    """Lists beyond the bits of a pass are judged in several, with the same verdicts."""
    pages = spark.createDataFrame([(i, f"http://a.h{i}.org/") for i in range(300)], "page_id long, url string")
    out = urlfilter.judge(pages, listed(spark, [f"h{i}.org" for i in range(0, 300, 3)]), [], max_bits=max_bits)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    out = out.collect()
    assert len(out) == 300 and all((r.verdict == "block") == (r.page_id % 3 == 0) for r in out)


def test_a_million_listed_keys(spark):
    """Through the cascade: no join in the plan, no wrong verdict, and some 10 bits a key."""
    pages = spark.range(300_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), (F.col("id") * 7).cast("string"), F.lit(".org/x")).alias("url"))
    keys = spark.range(0, 2_100_000, 2).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org")).alias("key"))
    out = urlfilter.judge(pages, keys, [])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    wrong = out.filter((F.col("verdict") == "block") != (F.col("page_id") * 7 % 2 == 0)).count()
    assert wrong == 0 and out.count() == 300_000


def test_cases(spark):
    urls = [
        (1, None, "", "", None, "allow"),
        (2, "no scheme", "", "", None, "allow"),
        (3, "HTTP://WWW.Example.ORG/es/x?y#z", "www.example.org", "/es/x", "example.org/es/", "block"),
        (4, "http://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"),
        (5, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        (6, "http://example.org", "example.org", "", None, "allow"),
        (7, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (8, "https://a.bad.com/fr/q", "a.bad.com", "/fr/q", "com/fr/", "allow"),
        (9, "https://a.bad.com?x=/fr/", "a.bad.com", "", None, "block"),
        (10, "https://bad.com#x", "bad.com", "", None, "block"),
        (11, "https://notbad.com/", "notbad.com", "/", None, "allow"),
        (12, "x://ÀB.com/de/" + "p" * 50_000, "Àb.com", "/de/" + "p" * 50_000, "com/de/", "block"),
        (12, "https://bad.com/", "bad.com", "/", None, "block"),
        (None, "a://b://c/d\ne", "b:", "//c/d\ne", None, "allow"),
    ]
    df = spark.createDataFrame([u[:2] + ("h",) for u in urls], "page_id long, url string, host string")
    out = urlfilter.judge(df, listed(spark, ["bad.com", None, "bad.com"]), RULES).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(u[0], *u[2:]) for u in urls], key=str)
    assert urlfilter.judge(df.filter("false"), listed(spark, ["bad.com"]), RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, listed(spark, []), []).collect()} == {"allow"}
