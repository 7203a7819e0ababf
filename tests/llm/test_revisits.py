"""Revisits on records with known answers."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm.revisits import canonical_url, resolved

DDL = "record_id long, type string, url string, ts long, headers map<string,string>, body string"


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://WWW.Example.com:443/A/b/?utm_source=x&b=2&a=1#frag", "example.com/A/b?a=1&b=2"),
        ("http://example.com/", "example.com"),
        ("example.com?gclid=1", "example.com"),
        ("http://m.example.com/x?ref=y", "m.example.com/x?ref=y"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("c")).first().c == want


def test_resolution(spark):
    rows = [
        (1, "response", "http://a.com/x", 100, {"etag": '"1"', "content-type": "t", "date": "old"}, "one"),
        (2, "response", "https://www.a.com/x#f", 200, {"etag": '"2"', "last-modified": "d"}, "two"),
        (3, "revisit", "http://a.com/x/", 150, {"etag": 'W/"1"', "date": "new", "content-length": "0"}, None),
        (4, "revisit", "http://a.com/x", 250, {"etag": '"1"'}, None),
        (5, "revisit", "http://a.com/x", 90, {}, None),
        (6, "revisit", "http://a.com/x", 100 + 5 * 86_400, {"last-modified": "d"}, None),
        (7, "revisit", "http://a.com/x", 300, None, None),
        (8, "revisit", None, 300, {}, None),
        (9, "revisit", "http://a.com/x", None, {}, None),
        (10, "response", "http://a.com/x", 290, {}, None),
        (11, "request", "http://a.com/x", 10, {}, "r"),
        (12, "response", "http://b.com", 5, {}, ""),
        (13, "revisit", "http://b.com", 5, {}, None),
        (12, "response", "http://b.com", 5, {}, ""),
    ]
    out = {r.record_id: r for r in resolved(spark.createDataFrame([(*r, "x") for r in rows], DDL + ", status string")).collect()}
    assert {i: (r.status, r.refers_to, r.body) for i, r in out.items()} == {
        3: ("resolved", 1, "one"), 4: ("mismatch", None, None), 5: ("no-original", None, None), 6: ("resolved", 2, "two"), 7: ("resolved", 2, "two"),
        8: ("no-original", None, None), 9: ("no-original", None, None), 13: ("resolved", 12, ""),
    }
    assert out[3].headers == {"etag": 'W/"1"', "date": "new", "content-type": "t"}
    assert resolved(spark.createDataFrame([], DDL)).count() == 0


def test_hot_url_over_many_stretches(spark):
    rows = [(i, "response" if i % 3 == 0 else "revisit", "http://h.com", i * 50_000, {}, "b" if i % 3 == 0 else None) for i in range(200)]
    out = {r.record_id: r.refers_to for r in resolved(spark.createDataFrame(rows, DDL)).collect()}
    assert out == {i: i - i % 3 for i in range(200) if i % 3}


def test_one_body_of_several_and_a_very_long_one(spark):
    long = "line of a page\n" * 200_000
    rows = [(1, "response", "http://a.com", 10, {}, b) for b in ("two", "one", "three")] + [(2, "response", "http://b.com", 10, {}, long), (3, "response", "http://c.com", 10, {}, "nobody asks")]
    rows += [(n, "revisit", f"http://{'ab'[n % 2]}.com", 20, {}, None) for n in range(10, 40)] * 2
    out = resolved(spark.createDataFrame(rows, DDL).repartition(4)).collect()
    assert len(out) == 60 and {(r.refers_to, r.body) for r in out} == {(1, "one"), (2, long)}
