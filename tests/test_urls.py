"""Literals of the standard and of the reference's rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import urls

BASE = "https://example.com/a/b/c?q#f"
JOINS = [
    ("d", "https://example.com/a/b/d"), ("../d", "https://example.com/a/d"), ("/d", "https://example.com/d"), ("//other.example/d", "https://other.example/d"),
    ("?x", "https://example.com/a/b/c?x"), ("#g", "https://example.com/a/b/c?q#g"), ("", "https://example.com/a/b/c?q"), ("../../../../d", "https://example.com/d"),
    ("https:d", "https://example.com/a/b/d"), ("http:d", "http://d/"), (".", "https://example.com/a/b/"), ("..", "https://example.com/a/"), ("./x/%2E%2e/y/.", "https://example.com/a/b/y/"),
    ("\\\\h.example\\x?a\\b", "https://h.example/x?a\\b"), (" \n/sp ace\t", "https://example.com/sp%20ace"), ("/é?ü=\"1'", "https://example.com/%C3%A9?%C3%BC=%221%27"), ("http://X.example:80/", "http://x.example/"),
    ("https://x.example:444", "https://x.example:444/"), ("mailto:a@b.example", None), ("http://exa mple.com/", None), ("http://exa%00mple.com/", None), ("http://h:99999/", None), ("http:///", None),
]
HOSTS = [
    ("2130706433", "127.0.0.1"), ("0x7f.1", "127.0.0.1"), ("0177.0.0.1", "127.0.0.1"), ("127.1", "127.0.0.1"), ("LOCALHOST", "localhost"), ("%31%32%37.0.0.1", "127.0.0.1"),
    ("256.1.1.1", None), ("1.2.3.4.5", None), ("a@b@c", "c"), ("bücher.example", "xn--bcher-kva.example"), ("BÜCHER.example:8", "xn--bcher-kva.example"), ("日本語.jp", "xn--wgv71a119e.jp"),
    ("xn--a", None), ("1.2.3.09", None), ("4294967295", "255.255.255.255"), ("4294967296", None), ("a.1.2.x", "a.1.2.x"), ("[::1]", "[::1]"), ("", None), ("a<b", None),
]


def test_references_resolve(spark):
    df = spark.createDataFrame(JOINS, "r string, want string").withColumn("b", F.lit(BASE))
    bad = [tuple(r) for r in urls.resolved(df, F.col("b"), F.col("r")).select("r", "want", urls.text("url").alias("got")).collect() if r.want != r.got]
    assert bad == []


def test_hosts(spark):
    df = spark.createDataFrame(HOSTS, "h string, want string")
    assert [tuple(r) for r in urls.with_host(df, F.col("h"), "got").collect() if r.want != r.got] == []
    no_base = spark.createDataFrame([("/just/a/path",), ("https://h/x",), (None,)], "r string")
    assert [r[0] for r in urls.resolved(no_base, F.lit(None).cast("string"), F.col("r")).select(urls.text("url")).collect()] == [None, "https://h/x", None]


@pytest.mark.parametrize(
    "ref, policy, want",
    [
        ("https://h/a//b///c?b=2&utm=1&a=1#f", {}, "https://h/a//b///c?b=2&utm=1&a=1"),
        ("https://h/a//b///c?b=2&utm=1&a=1#f", {"tracking": ("utm",), "sort_query": True, "collapse_slashes": True}, "https://h/a/b/c?a=1&b=2"),
        ("https://h/?utm=1", {"tracking": ("utm",)}, "https://h/"),
        ("https://user:pw@h/", {}, None),
        ("https://good.example\\@evil.example/", {}, "https://good.example/@evil.example/"),
        ("https://h/" + "a" * 9000, {}, None),
    ],
)
def test_identity(spark, ref, policy, want):
    df = urls.resolved(spark.createDataFrame([(ref,)], "r string"), F.lit(None).cast("string"), F.col("r"))
    assert df.select(urls.identity("url", **policy)).first()[0] == want
