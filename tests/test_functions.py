"""Functions whose cases the tables don't have."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect as d
from tidemark.functions import identity, robots, text, web
from tidemark.operators import dml, temporal, trend
from tidemark.operators.graph import connected_components
from tidemark.operators.simulation import Stream
from tidemark.sources import feeds, packed


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


SUBSTR = [("hello", s, n) for s in (-7, -3, 0, 1, 2, 5, 9) for n in (None, -2, 0, 2, 9)]


def test_substr_is_sqlites(spark):
    con = sqlite3.connect(":memory:")
    got = one(spark, *[d.substr(F.lit(x), s, n) for x, s, n in SUBSTR])
    want = tuple(con.execute("select substr(?,?)", (x, s)).fetchone()[0] if n is None else con.execute("select substr(?,?,?)", (x, s, n)).fetchone()[0] for x, s, n in SUBSTR)
    assert got == want


def test_arithmetic_is_sqlites(spark):
    con = sqlite3.connect(":memory:")
    pairs = [(7, 2), (-7, 2), (7, -2), (5, 0), (0, 3)]
    assert one(spark, *[d.int_divide(F.lit(a), F.lit(b)) for a, b in pairs]) == tuple(con.execute("select ?/?", p).fetchone()[0] for p in pairs)
    assert one(spark, *[d.modulo(F.lit(a), F.lit(b)) for a, b in pairs]) == tuple(con.execute("select ?%?", p).fetchone()[0] for p in pairs)
    shifts = [(1, 3), (1, 63), (1, 64), (-8, 70), (-8, -70), (8, -2)]
    assert one(spark, *[d.shift_left(F.lit(a).cast("long"), F.lit(b)) for a, b in shifts]) == tuple(con.execute("select ?<<?", p).fetchone()[0] for p in shifts)
    big = 9223372036854775807
    assert one(spark, d.add(F.lit(big), F.lit(1)))[0] == pytest.approx(2.0**63)
    prefixes = ["12abc", " -3.5e2x", "abc", ".5", ""]
    assert one(spark, *[d.real_prefix(F.lit(p)) for p in prefixes]) == tuple(float(con.execute("select cast(? as real)", (p,)).fetchone()[0]) for p in prefixes)


def test_nulls_in_lists_and_extremes(spark):
    x = F.lit(None).cast("int")
    assert one(spark, d.in_list(x, []), d.in_list(F.lit(1), []), d.greatest(F.lit(1), x), d.like(F.lit("ÀBC"), "àb%"), d.like(F.lit("aBC"), "AB%")) == (None, False, None, False, True)


def test_dates_are_sqlites(spark):
    con = sqlite3.connect(":memory:")
    days = ["2024-01-31 10:20:30", "2023-12-31 00:00:00", "2024-02-29 23:59:59", "2021-01-03 12:00:00"]
    mods = [("+1 month",), ("start of month", "+1 month", "-1 day"), ("weekday 1",), ("-1 year",), ("+36 hours",)]
    for m in mods:
        got = one(spark, *[d.strftime("%Y-%m-%d %H:%M:%S", d.modify(F.lit(x).cast("timestamp_ntz"), *m)) for x in days])
        assert got == tuple(con.execute(f"select datetime(?,{','.join('?' * len(m))})", (x, *m)).fetchone()[0] for x in days), m
    for f in ("%j", "%w", "%W", "%H-%M", "%%", "%s"):
        got = one(spark, *[d.strftime(f, F.lit(x).cast("timestamp_ntz")) for x in days])
        assert got == tuple(con.execute("select strftime(?,?)", (f, x)).fetchone()[0] for x in days), f
    assert one(spark, d.strftime("%Q", F.lit(days[0]).cast("timestamp_ntz"))) == (None,)


def test_json(spark):
    doc = F.lit('{"a":[1,{"b":true}],"s":"x"}')
    assert one(spark, d.json_extract(doc, "$.a[0]"), d.json_extract(doc, "$.a[#-1].b"), d.json_extract(doc, "$.zz"), d.json_extract(doc, "$.s")) == ("1", "1", None, "x")


def test_terms(spark):
    got = one(spark, text.terms(F.lit("The Ｍａｔｃｈａ tea 抹茶ラテ at it")), text.mentions("AI matcha", F.lit("matcha by AI")), text.mentions("AI", F.lit("maids")), text.mentions("抹茶", F.lit("抹 茶")))
    assert got == (sorted(["matcha", "tea", "抹茶", "茶ラ", "ラテ"]), True, False, False)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), text.entropy(F.lit("aabb"))) == (1.0, pytest.approx(1.0))


def test_codes_and_money(spark):
    codes = ["4006381333931", "4006381333932", "00000000", "036000291452", "x"]
    assert one(spark, *[identity.gtin14(F.lit(c)) for c in codes]) == ("04006381333931", None, None, "00036000291452", None)
    assert one(spark, identity.isbn10_as_gtin(F.lit("0-306-40615-2")), identity.isbn10_as_gtin(F.lit("0306406153"))) == ("09780306406157", None)
    assert one(spark, identity.minor_units(F.lit("1.234"), F.lit("USD")), identity.minor_units(F.lit("1.234"), F.lit("KWD")), identity.minor_units(F.lit("7"), F.lit("JPY"))) == (None, 1234, 7)
    urls = ["HTTP://Ex.com:80#a", "https://u:p@x.com/", "ftp://x", "http://a.b/c?z=1&utm=2&a=3"]
    assert one(spark, *[identity.canonical_url(F.lit(u), tracking=("utm",), sort_query=True) for u in urls]) == ("http://ex.com/", None, None, "http://a.b/c?a=3&z=1")


def test_page_lines():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><main><h1>Head</h1><p>one <b>two</b></p><p hidden>no</p><p style='display: none'>no</p></main><script>x</script><footer>foot</footer></body></html>"
    visible, main = web.lines_of(html)
    assert visible == ["menu", "Head", "one two", "foot"] and main == ["Head", "one two"]
    assert web.lines_of("<div>a<br>b</div><aside>c</aside>") == (["a", "b", "c"], ["a", "b"])


def test_robots():
    t = "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: bot\nDisallow: /*.pdf$\nAllow: /x\nDisallow: /x"
    assert [robots.allowed(t, "z", p) for p in ("/a/c", "/a/b", "/q")] == [False, True, True]
    assert [robots.allowed(t, "bot", p) for p in ("/f.pdf", "/f.pdfx", "/a", "/x")] == [False, True, True, False]
    tie = "User-agent: *\nDisallow: /a*\nAllow: /ab"
    assert robots.allowed(tie, "z", "/abc")  # different patterns of one length: allow
    assert robots.allowed(None, "bot", "/")


def test_feeds(spark):
    rss = b"<rss><channel><item><title>A</title><link>http://a</link><pubDate>d</pubDate><description>s</description></item></channel></rss>"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://b"/><updated>u</updated></entry></feed>'
    bad = b"<!DOCTYPE x [<!ENTITY e 'x'>]><rss/>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("b", bad), ("n", None)], "k string, b binary")
    assert sorted(map(tuple, feeds.feed_items(df, "k", "b").collect())) == [("a", "B", "http://b", "u", None), ("r", "A", "http://a", "d", "s")]
    import gzip

    site = gzip.compress(b'<urlset xmlns="http://s"><url><loc>http://x</loc><lastmod>2024</lastmod></url><url/></urlset>')
    assert feeds.sitemap_entries(spark.createDataFrame([("s", site[:-12]), ("t", site[:20] + b"xx" + site[22:])], "k string, b binary"), "k", "b").count() == 0
    assert list(map(tuple, feeds.sitemap_entries(spark.createDataFrame([("s", site)], "k string, b binary"), "k", "b").collect())) == [("s", "http://x", "2024", False)]


def test_packed(spark):
    df = spark.createDataFrame([(1, [0, 5, 10, -1]), (2, [])], "k int, p array<long>")
    assert sorted(map(tuple, packed.packed_series(df, ["k"], "p").collect())) == [(1, packed.EPOCH, 5), (1, packed.EPOCH + 600, None)]


def test_binomial_tails(spark):
    up, down = one(spark, *trend.binomial_tails(F.lit(4), F.lit(3), F.lit(0.5)))
    assert up == pytest.approx(5 / 16) and down == pytest.approx(15 / 16)
    up, down = one(spark, *trend.binomial_tails(F.lit(0), F.lit(0), F.lit(0.5)))
    assert up == pytest.approx(1) and down == pytest.approx(1)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 2), (2, 3), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {1: 1, 2: 1, 3: 1}
    assert connected_components(edges.limit(0)).count() == 0


def test_supersede_and_as_of(spark):
    w = spark.createDataFrame([(1, "a", 0, None, 5), (1, "b", 10, None, 20), (2, "a", 0, None, 1), (2, "b", 0, None, 1)], "k int, value string, valid_at long, invalid_at long, last_observed_at long")
    cut = temporal.supersede(w, ["k"])
    assert sorted((r.k, r.value, r.invalid_at) for r in cut.collect()) == [(1, "a", 10), (1, "b", None), (2, "a", None), (2, "b", None)]
    q = spark.createDataFrame([(1, 3), (1, 7), (1, 15), (1, 30), (1, -1), (2, 1)], "k int, t long")
    got = {(r.k, r.t): (r.value, r.state) for r in temporal.as_of(cut, q, ["k"], "t").collect()}
    assert got == {(1, 3): ("a", "OBSERVED"), (1, 7): ("a", "CHANGE_TIME_UNKNOWN"), (1, 15): ("b", "OBSERVED"), (1, 30): ("b", "NOT_OBSERVED_SINCE"), (1, -1): (None, "UNKNOWN"), (2, 1): (None, "CONFLICT")}


def test_upsert_keeps_null_keys_apart(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    n = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(dml.insert_or_ignore(t, n, ["k"], "v")) == sorted(map(str, [(1, "a"), (None, "b"), (None, "y"), (2, "z")]))
    assert rows(dml.insert_or_replace(t, n, ["k"], "v")) == sorted(map(str, [(1, "x"), (None, "b"), (None, "y"), (2, "z")]))


def test_random_streams_are_named():
    a, b = Stream(1, "x", 0), Stream(1, "x", 0)
    assert [a.uniform() for _ in range(3)] == [b.uniform() for _ in range(3)]
    assert Stream(1, "y", 0).uniform() != Stream(1, "x", 0).uniform()
