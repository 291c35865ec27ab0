"""Values as pages and protocols write them: prices, displayed counts and ages, codes, times, names; each held against its
number, so that the query reads what the fixture wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import availability, dialect, displayed, http, identity, price
from tidemark.functions import text as x
from tidemark.operators import frontier, temporal

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("displayed_counts", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS n FROM lineitem), t AS (SELECT *, l_linenumber % 4 AS k FROM v)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN n WHEN 1 THEN n // 100 * 100 WHEN 2 THEN n // 1000 * 10000 ELSE n * 10000 END AS nominal,
CASE k WHEN 0 THEN n WHEN 1 THEN greatest(n // 100 * 100 - 50, 0) WHEN 2 THEN greatest(n // 1000 * 10000 - 5000, 0) ELSE n * 10000 END AS lower,
CASE k WHEN 0 THEN n WHEN 1 THEN n // 100 * 100 + 99 WHEN 2 THEN n // 1000 * 10000 + 9999 END AS upper FROM t""")
def displayed_counts(spark, sf_dir):
    """Amounts as a page shows them: grouped, in thousands with a decimal, in ten thousands, and as at least so many."""
    n, k = F.floor("l_extendedprice"), F.col("l_linenumber") % 4
    thousands = F.concat(F.floor(n / 1000).cast("string"), F.lit("."), (F.floor(n / 100) % 10).cast("string"), F.lit("k"))
    shown = F.when(k == 0, F.format_number(n, 0)).when(k == 1, thousands).when(k == 2, F.concat(F.floor(n / 1000).cast("string"), F.lit(" 万"))).otherwise(F.concat(n.cast("string"), F.lit("w+")))
    b = displayed.count_bounds("shown")
    return table(spark, sf_dir, "lineitem").withColumn("shown", shown).select("l_orderkey", "l_linenumber", b["nominal"].alias("nominal"), b["lower"].alias("lower"), b["upper"].alias("upper"))


@query("displayed_ages", """WITH a AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS c, event_id % 50 AS n, event_id % 3 AS k FROM events)
SELECT event_id, c - (n + 1) * s AS earliest, c - n * s + CASE WHEN k = 2 THEN 0 ELSE s // 2 END AS latest FROM (SELECT *, CASE k WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 86400 END AS s FROM a)""")
def displayed_ages(spark, sf_dir):
    n, k = (F.col("event_id") % 50).cast("string"), F.col("event_id") % 3
    shown = F.when(k == 0, F.concat(n, F.lit("分钟前"))).when(k == 1, F.concat(n, F.lit(" 小时前"))).otherwise(F.concat(n, F.lit(" days ago")))
    e = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("c"), shown.alias("shown"))
    w = displayed.age_window("shown", F.col("c"))
    return e.select("event_id", w["earliest"].alias("earliest"), w["latest"].alias("latest"))


@query("price_texts", "SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS minor, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS currency FROM orders WHERE round(o_totalprice * 100) >= 100000")
def price_texts(spark, sf_dir):
    """Prices in four ways of writing, read as exact amounts."""
    v, k = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderkey") % 4
    whole, cents = F.format_number(F.floor(v / 100), 0), F.lpad((v % 100).cast("string"), 2, "0")
    german = F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), cents)
    shown = F.when(k == 0, F.concat(F.lit("$"), whole, F.lit("."), cents)).when(k == 1, F.concat(german, F.lit(" €"))).when(k == 2, F.concat(F.lit("€ "), F.replace(whole, F.lit(","), F.lit(" ")), F.lit(","), cents)).otherwise(F.concat(F.lit("£"), F.replace(whole, F.lit(","), F.lit("'")), F.lit("."), cents))
    o = table(spark, sf_dir, "orders").where(v >= 100_000).withColumn("shown", shown)
    read = price.amount("shown").cast("decimal(20,2)") * 100
    return o.select("o_orderkey", read.cast("long").cast("string").alias("minor"), price.currency("shown").alias("currency"))


@query("isbn_codes", """WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part),
c AS (SELECT *, (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(b, CAST(i AS BIGINT), 1) AS INTEGER) * (11 - i))) % 11) % 11 AS c10, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr('978' || b, CAST(i AS BIGINT), 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS c13 FROM b)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND c10 <> 0 THEN NULL ELSE '0978' || b || CAST(c13 AS VARCHAR) END AS gtin FROM c""")
def isbn_codes(spark, sf_dir):
    """Codes with their check digit as the sum of digits demands it; every third has a 0 in its place."""
    b = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    total = F.aggregate(F.transform(F.split(b, ""), lambda d, i: d.cast("int") * (10 - i)), F.lit(0), lambda a, v: a + v)
    digit = (11 - total % 11) % 11
    code = F.concat_ws("-", F.substring(b, 1, 4), F.substring(b, 5, 5), F.when(F.col("p_partkey") % 3 == 0, "0").when(digit == 10, "X").otherwise(digit.cast("string")))
    return table(spark, sf_dir, "part").withColumn("code", code).select("p_partkey", identity.isbn10_as_gtin("code").alias("gtin"))


@query("response_freshness", """WITH r AS (SELECT event_id, event_id % 6 AS k, user_id AS a, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT event_id, CASE k WHEN 0 THEN a WHEN 1 THEN 0 WHEN 2 THEN a * 60 WHEN 3 THEN a * 360 // 10 WHEN 4 THEN 0 ELSE 0 END AS lifetime, CASE k % 2 WHEN 0 THEN t + a ELSE t + 90 END AS retry_at FROM r""")
def response_freshness(spark, sf_dir):
    """Headers of six kinds: an age, not to be kept, an end, a last change, an end in the past, nothing."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("a"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 6).alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    written = lambda s: F.date_format(F.timestamp_seconds(s), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    k, t, a = F.col("k"), F.col("t"), F.col("a")
    e = e.withColumns({
        "cc": F.when(k == 0, F.concat(F.lit("public, max-age="), a.cast("string"))).when(k == 1, "max-age=9, no-store"),
        "date": written(t),
        "expires": F.when(k == 2, written(t + a * 60)).when(k == 4, written(t - 60)),
        "changed": F.when(k == 3, written(t - a * 360)),
        "retry": F.when(k % 2 == 0, a.cast("string")).otherwise(F.date_format(F.timestamp_seconds(t + 90), "EEEE, dd-MMM-yy HH:mm:ss 'GMT'")),
    })
    return e.select("event_id", http.freshness_lifetime("cc", "date", "expires", "changed").alias("lifetime"), http.retry_not_before("retry", t).alias("retry_at"))


@query("feed_times", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_ FROM events")
def feed_times(spark, sf_dir):
    """Times as feeds and JSON write them, in two zones."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    moved = F.timestamp_seconds(t + 5400)
    shown = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(moved, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0130"))).otherwise(F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
    e = table(spark, sf_dir, "events").withColumn("shown", shown)
    return e.select("event_id", F.coalesce(http.rfc3339("shown"), http.rfc822("shown")).alias("at_"))


@query("name_entropy", """WITH c AS (SELECT p_partkey, length(p_name) AS n, unnest(string_split(p_name, '')) AS c FROM part), k AS (SELECT p_partkey, n, c, count(*) AS k FROM c GROUP BY 1, 2, 3)
SELECT p_partkey, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 9) AS bits FROM k GROUP BY 1""")
def name_entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x.entropy("p_name"), 9).alias("bits"))


@query("name_similarity", r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g')) AS n FROM part),
g AS (SELECT *, list_distinct(list_transform(range(1, length(replace(n, ' ', '')) - 1), lambda i: substr(replace(n, ' ', ''), CAST(i AS BIGINT), 3))) AS g FROM n)
SELECT a.p_partkey, a.n AS name, round(len(list_intersect(a.g, b.g)) * 1.0 / len(list_distinct(list_concat(a.g, b.g))), 9) AS similarity FROM g a JOIN g b ON b.p_partkey = a.p_partkey + 1""")
def name_similarity(spark, sf_dir):
    """Each part's name against the next one's: normalised, in runs of three characters without spaces."""
    n = table(spark, sf_dir, "part").select("p_partkey", x.normal_fuzzy(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))
    g = n.withColumn("g", x.grams(F.replace("name", F.lit(" "), F.lit("")), 3))
    after = g.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("g").alias("h"))
    return g.join(after, "p_partkey").select("p_partkey", "name", F.round(x.jaccard("g", "h"), 9).alias("similarity"))


@query("clipped_spans", "SELECT event_id, greatest(t, 1705000000) AS start, least(t + 40000, 1705600000) AS \"end\" FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WHERE least(t + 40000, 1705600000) > greatest(t, 1705000000)")
def clipped_spans(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    spans = s.withColumn("end", F.col("start") + 40_000)
    return temporal.clip(spans, F.lit(1_705_000_000), F.lit(1_705_600_000))


@query("value_types", "SELECT o_orderkey, 'integer' AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'real' END AS b, 'text' AS c, o_orderkey % 2 IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS d, CAST(o_orderkey AS DOUBLE) + o_custkey AS e FROM orders")
def value_types(spark, sf_dir):
    """The dialect's type names, its null-safe comparison, and addition."""
    maybe = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    one = F.when(F.col("o_orderkey") % 3 != 0, F.lit(1).cast("long"))
    o = table(spark, sf_dir, "orders").withColumns({"maybe": maybe, "one": one})
    return o.select("o_orderkey", dialect.type_name("o_orderkey").alias("a"), dialect.type_name("maybe").alias("b"), dialect.type_name("o_orderstatus").alias("c"), (~(F.col("o_orderkey") % 2).eqNullSafe(F.col("one"))).alias("d"), dialect.add("o_orderkey", "o_custkey").alias("e"))


@query("short_words", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) = 2 AND w NOT IN ('an', 'as', 'at', 'be', 'by', 'do', 'go', 'he', 'if', 'in', 'is', 'it', 'me', 'my', 'no', 'of', 'on', 'or', 'so', 'to', 'up', 'us', 'we')))), ' ') AS words FROM benchmark")
def short_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(x.short_words("text")), " ").alias("words"))


LEASES = """WITH u AS (SELECT page_id AS url_id, 'o' || page_id % 7 AS origin, CASE WHEN page_id % 4 = 0 THEN 'LEASED' WHEN page_id % 4 = 1 THEN 'RETRYABLE' WHEN page_id % 4 = 2 THEN 'HANDLED' ELSE 'QUEUED' END AS state, page_id % 5 AS priority, 900 + page_id % 150 AS next_at, page_id * 3 % 101 AS discovered_at FROM pages),
b AS (SELECT origin, count(*) AS busy FROM u WHERE state = 'LEASED' GROUP BY 1),
r AS (SELECT u.*, coalesce(busy, 0) AS busy, row_number() OVER (PARTITION BY u.origin ORDER BY priority DESC, next_at, discovered_at, url_id) AS k FROM u LEFT JOIN b ON b.origin = u.origin WHERE state IN ('QUEUED', 'RETRYABLE') AND next_at <= 1000 AND u.origin <> 'o3')
SELECT url_id, origin FROM r WHERE busy < 40 AND k <= 40 - busy ORDER BY priority DESC, next_at, discovered_at, url_id LIMIT (SELECT greatest(0, 120 - count(*)) FROM u WHERE state = 'LEASED')"""


@query("next_leases", LEASES)
def next_leases(spark, sf_dir):
    """Which pages are leased next: ready, by priority, under the limits of their origin and of all, none of an origin that cools down."""
    k = F.col("page_id") % 4
    u = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), F.concat(F.lit("o"), F.col("page_id") % 7).alias("origin"), F.when(k == 0, "LEASED").when(k == 1, "RETRYABLE").when(k == 2, "HANDLED").otherwise("QUEUED").alias("state"), (F.col("page_id") % 5).alias("priority"), (900 + F.col("page_id") % 150).alias("next_at"), (F.col("page_id") * 3 % 101).alias("discovered_at"))
    origins = spark.createDataFrame([("o3", 2000), ("o4", 10)], "origin string, next_at long")
    return frontier.next_leases(u, origins, F.lit(1000), 40, 120).select("url_id", "origin")


@query("availability_classes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'ORDERABLE' ELSE 'UNKNOWN' END AS class FROM part")
def availability_classes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    shown = F.when(k == 0, "https://schema.org/InStock").when(k == 1, "schema:out_of_stock").when(k == 2, " Pre-Order ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("shown", shown).select("p_partkey", availability.availability_class("shown").alias("class"))
