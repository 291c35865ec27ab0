"""Operators on fixtures of their own."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import displayed, http
from tidemark.operators import clusters, frontier
from tidemark.operators.names import resolve
from tidemark.sources import social


def test_displayed_counts_and_ages(spark):
    texts = ["1.2万", "3k+", "532", "1,204", "2.5M", "n/a", None]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(displayed.count_bounds("t").alias("b")).collect()]
    assert got == [(12000, 11500, 12999), (3000, 3000, None), (532, 532, 532), (1204, 1204, 1204), (2500000, 2450000, 2599999), None, None]
    texts = ["10w+", "3.05亿", "1.5k", "1,234", "1.23456k", "12,34", "1.2", "1e3", "1,234万"]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(displayed.count_bounds("t").alias("b")).collect()]
    assert got == [(100000, 100000, None), (305000000, 304500000, 305999999), (1500, 1450, 1599), (1234, 1234, 1234), None, None, None, None, None]
    near = spark.range(1).select(displayed.age_window(F.lit("3分钟前"), F.lit(10_000)).alias("a"), displayed.age_window(F.lit("2 小时前"), F.lit(100_000)).alias("b")).first()
    assert (tuple(near.a), tuple(near.b)) == ((9760, 9850), (89200, 94600))
    ages = ["3 hours ago", "2d", "soon"]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame(list(enumerate(ages)), "i int, t string").orderBy("i").select(displayed.age_window("t", F.lit(1_000_000)).alias("b")).collect()]
    assert got == [(1_000_000 - 4 * 3600, 1_000_000 - 3 * 3600), (1_000_000 - 3 * 86400, 1_000_000 - 2 * 86400), None]


def test_http_times(spark):
    when = 784111777
    forms = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994"]
    row = spark.range(1).select(
        *[http.http_date(F.lit(f)).alias(f"a{i}") for i, f in enumerate(forms)],
        http.rfc3339(F.lit("1994-11-06T08:49:37Z")).alias("b"),
        http.rfc3339(F.lit("1994-11-06 08:49:37")).alias("c"),
        http.rfc822(F.lit("Sun, 06 Nov 1994 09:49:37 +0100")).alias("d"),
        http.retry_not_before(F.lit("120"), F.lit(1000)).alias("e"),
        http.freshness_lifetime(F.lit("public, max-age=60"), F.lit(forms[0]), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("f"),
        http.freshness_lifetime(F.lit("no-store, max-age=60"), F.lit(forms[0]), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("g"),
        http.freshness_lifetime(F.lit(None).cast("string"), F.lit(forms[0]), F.lit("Sun, 06 Nov 1994 08:50:37 GMT"), F.lit(None).cast("string")).alias("h"),
    ).first()
    assert tuple(row) == (when, when, when, when, None, when, 1120, 60, 0, 60)


def test_name_resolution(spark):
    known = spark.createDataFrame([(1, "Acme Rocket Company"), (2, "Globex  Corporation"), (3, "Twice Named"), (4, "twice named"), (5, "aaa")], "id long, name string")
    names = spark.createDataFrame([(10, "globex corporation"), (11, "Acme Rocket, Company!"), (12, "Twice  Named"), (13, "Initech Software"), (14, "aaaa"), (15, None)], "id long, name string")
    got = {r.id: (r.match, r.state) for r in resolve(names, known).collect()}
    assert got == {10: (2, "EXACT"), 11: (1, "SIMILAR"), 12: (None, "UNRESOLVED"), 13: (None, "UNRESOLVED"), 14: (None, "UNRESOLVED"), 15: (None, "UNRESOLVED")}


def test_leader_clusters():
    rows = pd.DataFrame({"topic": "t", "post_id": [1, 2, 3, 4, 5], "published": [0.0, 10.0, 700_000.0, None, 20.0], "terms": [list("abcd"), list("abce"), list("abcd"), list("abcd"), list("wxyz")]})
    assert clusters.lead(rows)["leader"].tolist() == [1, 1, 3, 4, 5]


def test_budgeted_actions(spark):
    rows = [("p", "a", "u1", "g1", 10.0, 1, 0, 0, 0), ("p", "b", "u2", "g1", 9.0, 1, 0, 0, 0), ("p", "c", "u3", "g2", 5.0, 2, 0, 0, 0), ("p", "d", "u4", "g3", 1.0, 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "plan string, action string, url string, gap string, points double, requests int, latency_ms int, redundancy int, cost int")
    assert [tuple(r) for r in clusters.budgeted_actions(df, 2, 10).orderBy("k").collect()] == [("p", "a", 1), ("p", "d", 2)]


def test_frontier(spark):
    cols = "url_id int, origin string, state string, priority int, next_at long, discovered_at long, attempts int, lease_until long"
    rows = [(1, "a", "QUEUED", 1, 0, 0, 0, None), (2, "a", "QUEUED", 5, 0, 1, 0, None), (3, "b", "QUEUED", 9, 50, 0, 0, None), (4, "c", "QUEUED", 2, 0, 0, 0, None), (5, "d", "LEASED", 2, 0, 0, 4, 5), (6, "d", "LEASED", 2, 0, 0, 1, 5), (7, "e", "QUEUED", 1, 0, 0, 0, None)]
    urls = spark.createDataFrame(rows, cols)
    back = frontier.reclaimed(urls, F.lit(10), 3)
    assert {r.url_id: r.state for r in back.collect() if r.origin == "d"} == {5: "FAILED", 6: "RETRYABLE"}
    cool = spark.createDataFrame([("c", 99)], "origin string, next_at long")
    got = [r.url_id for r in frontier.next_leases(back, cool, F.lit(10), 1, 3).collect()]
    assert got == [2, 6, 7]
    waits = [r[0] for r in spark.createDataFrame([(1, None), (4, None), (9, None), (1, 77)], "n int, r int").select(frontier.backoff(F.col("n"), 10, 500, F.col("r"))).collect()]
    assert waits == [10, 80, 500, 77]
    found = spark.createDataFrame([("r", "h1", "u", "o", 1, 5), ("r", "h1", "v", "o", 1, 3), ("r", "h2", "w", "o", 9, 1), ("r", "h0", "x", "o", 1, 1)], "run_id string, identity string, url string, origin string, depth int, discovered_at long")
    known = spark.createDataFrame([("r", "h0")], "run_id string, identity string")
    assert [(r.identity, r.url) for r in frontier.enqueue(known, found, 3).collect()] == [("h1", "v")]


def test_social_posts(spark):
    hn = json.dumps({"hits": [{"objectID": "1", "author": "a", "comment_text": "<p>x &amp; y<br>z", "created_at_i": 5, "points": None, "parent_id": 7}]})
    sky = json.dumps({"posts": [{"uri": "at://1", "author": {"handle": "h"}, "record": {"text": "hi #Tea", "createdAt": "1970-01-01T00:00:09Z"}, "likeCount": 0}]})
    toot = json.dumps([{"id": "9", "account": {"acct": "m"}, "content": "<p>a</p><p>b</p>", "created_at": "1970-01-01T00:01:00.000Z", "tags": [{"name": "t"}]}])
    df = spark.createDataFrame([("hackernews", hn), ("bluesky", sky), ("mastodon", toot), ("mastodon", "not json"), ("hackernews", None)], "platform string, body string")
    got = {r.platform: r for r in social.posts(df).collect()}
    assert len(got) == 3 and got["hackernews"].text == "x & y\nz" and got["hackernews"].likes is None and got["hackernews"].parent == "7"
    assert got["bluesky"].tags == ["Tea"] and got["bluesky"].likes == 0 and got["bluesky"].published == 9
    assert got["mastodon"].text == "a\nb" and got["mastodon"].published == 60
    days = json.dumps({"name": "t", "history": [{"day": "0", "uses": "3", "accounts": "2"}, {"day": "86400", "uses": "1", "accounts": "1"}]})
    assert [tuple(r) for r in social.tag_usage(spark.createDataFrame([(days,)], "body string"), F.lit(90_000)).orderBy("day").collect()] == [("t", 0, 3, 2, True), ("t", 86400, 1, 1, False)]


def test_registered_functions_run_in_sql(spark):
    spark.udf.register("twice", lambda s: s and s * 2, "string")
    assert spark.sql("SELECT twice('ab') AS x").first().x == "abab"


@pytest.mark.parametrize("sql", ["SELECT :a + 1 AS x", "SELECT ? + 1 AS x"])
def test_parameters(spark, sql):
    args = {"a": 4} if ":a" in sql else [4]
    assert spark.sql(sql, args=args).first().x == 5


def test_prices(spark):
    from tidemark.functions import price

    texts = ["1.234,56 €", "$1,234.56", "¥1,980", "1.234 EUR", "12,5 kg", "1 234,00", "1'234.5 CHF", "12.345.678", "free", "US$0.99", "1,23,456.7"]
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(price.amount("t"), price.currency("t")).collect()]
    assert got == [("1234.56", "EUR"), ("1234.56", "USD"), ("1980", "JPY"), ("1234", "EUR"), ("12.5", None), ("1234.00", None), ("1234.5", "CHF"), ("12345678", None), (None, None), ("0.99", "USD"), ("123456.7", None)]


def test_availability(spark):
    from tidemark.functions import availability as a

    texts = ["http://schema.org/InStock", "out_of_stock", "Pre-Order", "whatever", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(a.availability_class("t")).collect()]
    assert got == ["AVAILABLE", "UNAVAILABLE", "ORDERABLE", "UNKNOWN", "UNKNOWN"]


def test_products(spark):
    from tidemark.sources import products

    ld = '<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"A","brand":{"name":"B"},"gtin13":"4006381333931","offers":[{"price":1.10,"priceCurrency":"EUR","availability":"http://schema.org/InStock"}]}]}</script><script type="application/ld+json">{bad</script>'
    micro = '<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">My <b>thing</b></h1><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="5.00"><span itemprop="priceCurrency">USD</span></div><span itemprop="sku">S1</span></div>'
    og = '<meta property="og:type" content="product"><meta property="og:title" content="T"><meta property="product:price:amount" content="9">'
    df = spark.createDataFrame([(1, ld), (2, micro), (3, og), (4, "<p>none</p>"), (5, None)], "id int, html string")
    got = {r.key: tuple(r)[1:] for r in products.products(df, "id", "html").collect()}
    assert got == {
        "1": ("JSON_LD", "A", "B", None, "4006381333931", "1.10", "EUR", "http://schema.org/InStock", None),
        "2": ("MICRODATA", "My thing", None, "S1", None, "5.00", "USD", None, None),
        "3": ("OPEN_GRAPH", "T", None, None, None, "9", None, None, None),
    }


def test_hosts(spark):
    from tidemark.functions import hosts

    rules = spark.createDataFrame([("com", "normal"), ("co.uk", "normal"), ("uk", "normal"), ("ck", "wildcard"), ("www.ck", "exception")], "suffix string, kind string")
    names = ["a.b.com", "com", "x.co.uk", "co.uk", "a.b.ck", "b.ck", "www.ck", "shop.www.ck", "1.2.3.4", "a..com", "deep.site.unknown", "Host.COM."]
    got = {r.host: r.domain for r in hosts.registrable_domains(spark.createDataFrame([(n,) for n in names], "host string"), rules).collect()}
    assert got == {"a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "shop.www.ck": "www.ck", "1.2.3.4": None, "a..com": None, "deep.site.unknown": "site.unknown", "Host.COM.": "host.com"}
    ips = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("::1",), ("x",), (None,)], "ip string")
    assert [r[0] for r in ips.select(hosts.is_public_address("ip")).collect()] == [True, False, False, None, None]


def test_price_statistics(spark):
    from tidemark.operators import prices

    day = 86400
    w = [("a", 1000, 0, 30 * day), ("a", 900, 30 * day, 31 * day), ("a", 1200, 31 * day, 32 * day), ("b", 1000, 0, 100), ("b", 1200, 200, 300), ("c", 1000, 0, 100), ("c", 1100, 50, 100), ("d", 5, 7, 7), ("e", 5, 7, 9)]
    windows = spark.createDataFrame(w, "k string, value long, valid_at long, last_observed_at long")
    money = spark.createDataFrame([("e", "JPY"), ("e", "USD"), ("a", "JPY")], "k string, currency string")
    got = {r.k: r for r in prices.observed_prices(windows, ["k"], money).collect()}
    a = got["a"]
    assert (a.state, a.low, a.p25, a.median, a.p75, a.high, a.share_below_latest_bps, a.unobserved_seconds) == ("DERIVED", 900, 1000, 1000, 1000, 1200, 9687, 0)
    assert (got["b"].observed_seconds, got["b"].unobserved_seconds) == (200, 100)
    assert [(got[k].state, got[k].reason, got[k].low) for k in "cde"] == [("CONFLICT", "OVERLAPPING_PRICE_WINDOWS", None), ("INSUFFICIENT_DURATION", None, None), ("CONFLICT", "MORE_THAN_ONE_CURRENCY", None)]
    s = [("x", 0, 1000), ("x", 10 * day, None), ("x", 20 * day, 800)]
    x = prices.price_history(spark.createDataFrame(s, "k string, t long, v long"), ["k"], "t", "v", F.lit(30 * day)).first()
    assert (x.unavailable_share, x.low, x.high, x.discounts, x.trend_bps, x.latest) == (pytest.approx(1 / 3), 800, 1000, 1, None, 800) and x.trend_status.startswith("INSUFFICIENT")
    s = [("y", 0, 1000), ("y", 90 * day, 1100)]
    y = prices.price_history(spark.createDataFrame(s, "k string, t long, v long"), ["k"], "t", "v", F.lit(180 * day)).first()
    assert (y.trend_bps, y.discounts, y.cv_bps, y.trend_status) == (1000, 0, 476, "DERIVED")
    assert prices.price_history(spark.createDataFrame([], "k string, t long, v long"), ["k"], "t", "v", F.lit(1)).count() == 0


def test_long_reply_chains_and_cycles(spark):
    from tidemark.operators.graph import depths

    rows = [(str(i), str(i - 1) if i else None) for i in range(30)] + [("a", "b"), ("b", "a"), ("z", "gone")]
    got = {r.id: (r.root, r.depth) for r in depths(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    assert got == {str(i): ("0", i) for i in range(30)} | {"z": ("z", 0)}


def test_text_rules(spark):
    from tidemark.functions import text

    row = spark.range(1).select(
        *[text.informative(F.lit(t)).alias(f"i{k}") for k, t in enumerate(("2024", "a1b2c3", "640x480", "です", "the", "matcha"))],
        text.script_words(F.lit("抹茶のスーパーカップ")).alias("s"),
        text.bracketed_spans(F.lit("「Big  Cup」と『x』と【!!】")).alias("b"),
        text.name_holds(F.lit("Goat Milk 1l"), "oat milk").alias("n1"),
        text.name_holds(F.lit("Best OAT-milk"), "oat milk").alias("n2"),
        text.name_holds(F.lit("宇治 抹茶 ラテ"), "抹茶ラテ").alias("n3"),
    ).first()
    assert list(row)[:6] == [False, False, False, False, False, True]
    assert (row.s, row.b, row.n1, row.n2, row.n3) == (["抹茶", "スーパーカップ"], ["big cup"], False, True, True)


def test_date_modifiers(spark):
    from tidemark.functions import dialect as d

    day = lambda t, *m: F.date_format(d.modify(F.lit(t).cast("timestamp_ntz"), *m), "yyyy-MM-dd HH:mm")
    row = spark.range(1).select(day("2024-01-31", "+1 month").alias("a"), day("2024-01-31", "+1 month", "floor").alias("b"), day("2024-01-31", "+1 month", "ceiling").alias("c"), day("2024-02-29 23:00:00", "+02:30").alias("e")).first()
    assert tuple(row) == ("2024-03-02 00:00", "2024-02-29 00:00", "2024-03-02 00:00", "2024-03-01 01:30")
    with pytest.raises(ValueError):
        d.strftime("%J", "x")
    doc = F.lit('{"t": "true", "b": true}')
    row = spark.range(1).select(d.json_extract(doc, "$.t").alias("t"), d.json_extract(doc, "$.b").alias("b"), d.json_extract(F.lit(None).cast("string"), "$.b").alias("n")).first()
    assert tuple(row) == ("true", "1", None)
    with pytest.raises(Exception, match="malformed"):
        spark.range(1).select(d.json_extract(F.lit("{oops"), "$.a")).collect()
