from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.url_filter import host_reputation, registered_domain, split_url, url_filter
from tests import oracle


@pytest.mark.parametrize(
    "url,host,path",
    [
        ("http://WWW.Example.ORG/a/B?q#f", "www.example.org", "/a/B"),
        ("x://h", "h", ""),
        ("x://h?q=/a", "h", ""),
        ("x://h#/a", "h", ""),
        ("no scheme/a", "", ""),
        (None, "", ""),
        ("://", "", ""),
        ("a://b://c/d", "b:", "//c/d"),
    ],
)
def test_split(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(*split_url(F.col("url"))).first()) == (host, path)


@pytest.mark.parametrize("host,domain", [("a.b.example.com", "example.com"), ("shop.x.co.uk", "x.co.uk"), ("co.uk", "co.uk"), ("localhost", "localhost"), ("", "")])
def test_domains(spark, host, domain):
    assert spark.createDataFrame([(host,)], "h string").select(registered_domain(F.col("h"))).first()[0] == domain


@pytest.mark.parametrize(
    "url,rule,verdict",
    [
        ("http://a.org/x", "org/", "allow"),
        ("http://org/x", "org/", "allow"),
        ("http://a.example.org/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "org/", "allow"),
        ("http://badexample.org/es/x", "org/", "allow"),
        ("http://b.com/fr/x", "com/fr/", "allow"),
        ("http://b.com/de/x", "com/de/", "block"),
        ("http://b.org", None, None),
        ("http://b.org?x", None, None),
    ],
)
def test_rules(spark, url, rule, verdict):
    none = spark.createDataFrame([], "host string, good int")
    r = url_filter(spark.createDataFrame([(1, url)], "page_id long, url string"), none, queries.URL_RULES).first()
    assert r.rule == rule and (verdict is None or r.verdict == verdict)


def test_shrinkage(spark):
    rows = [("good.a.com", 1)] * 200 + [("bad.b.com", 0)] * 200 + [("few.a.com", 0)] + [("x.c.net", 1), ("x.c.net", None)]
    by_host, by_domain, by_suffix, everything = host_reputation(spark.createDataFrame(rows, "host string, good int"))
    mean = {r.host: r.a / (r.a + r.b) for r in by_host.collect()}
    assert mean["good.a.com"] > 0.95 and mean["bad.b.com"] < 0.05
    assert 0 < mean["few.a.com"] < 1 and mean["few.a.com"] > mean["bad.b.com"]  # one bad page is drawn towards its good domain
    pages = spark.createDataFrame([(1, "x://good.a.com/"), (2, "x://bad.b.com/"), (3, "x://new.a.com/"), (4, "x://new.b.com/"), (5, None)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter(pages, spark.createDataFrame(rows, "host string, good int")).collect()}
    assert [got[i].verdict for i in (1, 2, 4)] == ["allow", "block", "block"] and got[3].reputation > got[4].reputation and got[5].host == ""


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (1, "", 1, 2)], "page_id long, url string, reputation int, domain int")
    none = spark.createDataFrame([], "host string, good int")
    assert [(r.host, r.path, r.rule, r.verdict) for r in url_filter(df, none).collect()] == [("", "", None, "block")] * 3
    assert url_filter(df.limit(0), none).count() == 0


def test_query_matches_sql(spark, sf_dir):
    oracle.assert_same(queries.op10_url_filter(spark, sf_dir), oracle.tables(sf_dir), queries.OP10_SQL)
