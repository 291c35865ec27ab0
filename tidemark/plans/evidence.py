"""Entity resolution, price statistics and evidence: what is known of products, and how well."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import entities as e
from tidemark.operators import prices, trend

from .registry import Registry, table
from .temporal import END, KEY, SERIES, series

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

RECORDS = """WITH r AS (SELECT p_partkey AS id, p_partkey % 6 AS k, 'https://shop' || (p_size % 5) || '.example' AS origin, 'https://shop' || (p_size % 5) || '.example/p/' || p_size AS source, p_type AS title, p_brand AS brand,
  CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_size % 2 = 0 THEN '4006381333931' ELSE '036000291452' END WHEN p_partkey % 6 = 1 THEN '4006381333930' END AS gtin, CASE WHEN p_partkey % 12 = 0 THEN '978-3-473-48878-0' END AS isbn,
  CASE WHEN p_partkey % 6 = 2 THEN 'b00' || lpad(CAST(p_size AS VARCHAR), 7, '0') END AS asin, CASE WHEN p_partkey % 6 = 3 THEN 'M' || p_size END AS mpn, CASE WHEN p_partkey % 6 IN (0, 4) THEN 'S' || (p_size % 7) END AS sku,
  CASE WHEN p_partkey % 5 = 0 THEN 'Red' END AS color FROM part),
k AS (SELECT *, coalesce(lower(color), '') || '|' AS variant, CASE gtin WHEN '4006381333931' THEN '04006381333931' WHEN '036000291452' THEN '00036000291452' END AS code FROM r),
i AS (SELECT *, CASE WHEN code IS NOT NULL AND isbn IS NOT NULL THEN 'gtin_conflict:' || code || '+09783473488780:' || source || ':' || variant WHEN code IS NOT NULL THEN 'gtin:' || code || ':' || variant
  WHEN asin IS NOT NULL THEN 'asin:' || origin || ':' || upper(asin) || ':' || variant WHEN mpn IS NOT NULL THEN 'mpn:' || lower(brand) || ':' || lower(mpn) || ':' || variant || ':sku:'
  WHEN sku IS NOT NULL THEN 'sku:' || origin || ':' || lower(brand) || ':' || lower(sku) || ':' || variant ELSE 'page:' || source || ':' || lower(title) || ':' || variant END AS own FROM k),
a AS (SELECT origin, sku, variant, min(own) AS coded FROM i WHERE own LIKE 'gtin:%' AND sku IS NOT NULL GROUP BY ALL HAVING count(DISTINCT own) = 1),
b AS (SELECT source, lower(title) AS page, min(own) AS named FROM i WHERE own NOT LIKE 'page:%' AND color IS NULL GROUP BY ALL HAVING count(DISTINCT own) = 1),
d AS (SELECT i.*, coalesce(CASE WHEN own LIKE 'sku:%' THEN coded WHEN own LIKE 'page:%' AND color IS NULL THEN named END, own) AS identity FROM i LEFT JOIN a USING (origin, sku, variant) LEFT JOIN b ON b.source = i.source AND b.page = lower(i.title)) """


def records(spark, sf_dir):
    """Parts as records of five shops that state one kind of key each."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    fields = {
        "source": F.concat(F.lit("https://shop"), F.col("p_size") % 5, F.lit(".example/p/"), size),
        "title": F.col("p_type"),
        "brand": F.col("p_brand"),
        "gtin": F.when(k == 0, F.when(F.col("p_size") % 2 == 0, "4006381333931").otherwise("036000291452")).when(k == 1, "4006381333930"),
        "isbn": F.when(F.col("p_partkey") % 12 == 0, "978-3-473-48878-0"),
        "asin": F.when(k == 2, F.concat(F.lit("b00"), F.lpad(size, 7, "0"))),
        "mpn": F.when(k == 3, F.concat(F.lit("M"), size)),
        "sku": F.when(k.isin(0, 4), F.concat(F.lit("S"), F.col("p_size") % 7)),
        "color": F.when(F.col("p_partkey") % 5 == 0, "Red"),
    }
    rest = [F.lit(None).cast("string").alias(f) for f in e.FIELDS if f not in fields]
    return p.select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in fields.items()], *rest)


@query(
    "entity_resolution",
    RECORDS
    + """SELECT identity, count(*) AS members, count(DISTINCT source) AS sources, min(id) AS first, concat_ws(',', CASE WHEN count(DISTINCT title) > 1 THEN 'title' END, CASE WHEN count(DISTINCT brand) > 1 THEN 'brand' END,
CASE WHEN count(DISTINCT sku) > 1 THEN 'sku' END, CASE WHEN count(DISTINCT gtin) > 1 THEN 'gtin' END, CASE WHEN count(DISTINCT mpn) > 1 THEN 'mpn' END) AS conflicts, CASE WHEN count(DISTINCT brand) = 1 THEN min(brand) END AS brand FROM d GROUP BY identity""",
)
def entity_resolution(spark, sf_dir):
    return e.entities(records(spark, sf_dir), "id").select("identity", "members", "sources", "first", F.concat_ws(",", "conflicts").alias("conflicts"), "brand")


@query("identity_links", RECORDS + "SELECT id, identity, CASE WHEN identity <> own THEN 'ANCHORED' ELSE 'OWN' END AS how FROM d")
def identity_links(spark, sf_dir):
    r = records(spark, sf_dir)
    own = e.keyed(r).select("id", F.col("identity").alias("own"))
    return e.resolved(r).select("id", "identity").join(own, "id").select("id", "identity", F.when(F.col("identity") != F.col("own"), "ANCHORED").otherwise("OWN").alias("how"))


@query(
    "identifier_claims",
    RECORDS
    + """SELECT id, 'gtin' AS field, gtin AS stated, CASE WHEN code IS NULL THEN 'INVALID_CHECK_DIGIT' ELSE 'VALID_GTIN' END AS state, code AS gtin14 FROM k WHERE gtin IS NOT NULL
UNION ALL SELECT id, 'isbn', isbn, 'VALID_ISBN13_AS_GTIN13', '09783473488780' FROM k WHERE isbn IS NOT NULL""",
)
def identifier_claims(spark, sf_dir):
    return e.claims(records(spark, sf_dir), "id")


@query(
    "identifier_links",
    """WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'GTIN' WHEN 1 THEN 'ASIN' WHEN 2 THEN 'SKU' ELSE 'TITLE' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN '73513537' ELSE '73513538' END WHEN 1 THEN 'B000000001' ELSE 'X' END AS a,
CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_nationkey % 3 = 0 THEN '73513537' ELSE '73513538' END WHEN 1 THEN 'B000000001' ELSE CASE WHEN s_nationkey % 2 = 0 THEN 'X' END END AS b, s_nationkey % 2 = 0 AS here FROM supplier)
SELECT id, CASE WHEN b IS NULL THEN 'UNRESOLVED' WHEN a <> b THEN CASE WHEN kind = 'GTIN' THEN 'CONFLICT' ELSE 'DERIVED_WEAK_MATCH' END WHEN kind = 'GTIN' THEN CASE WHEN a = '73513537' THEN 'EXACT_IDENTIFIER' ELSE 'CONFLICT' END
WHEN kind = 'ASIN' THEN CASE WHEN here THEN 'EXACT_IDENTIFIER' ELSE 'DERIVED_WEAK_MATCH' END WHEN kind = 'SKU' THEN 'SOURCE_ASSERTED' ELSE 'DERIVED_WEAK_MATCH' END AS state FROM s""",
)
def identifier_links(spark, sf_dir):
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    kind = F.when(k == 0, "GTIN").when(k == 1, "ASIN").when(k == 2, "SKU").otherwise("TITLE")
    code = lambda m: F.when(n % m == 0, "73513537").otherwise("73513538")
    a = F.when(k == 0, code(2)).when(k == 1, "B000000001").otherwise("X")
    b = F.when(k == 0, code(3)).when(k == 1, "B000000001").when(n % 2 == 0, "X")
    market = F.when(n % 2 == 0, "JP").otherwise("US")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), e.link_state(kind, a, kind, b, F.lit("JP"), market).alias("state"))


@query(
    "price_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS prices, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, min(l_extendedprice) AS min, quantile_disc(l_extendedprice, 0.5) AS median, max(l_extendedprice) AS max,
strftime(min(l_shipdate), '%Y-%m-%d') AS earliest, strftime(max(l_shipdate), '%Y-%m-%d') AS latest, count(DISTINCT l_suppkey) AS stores, count(DISTINCT l_partkey) AS products FROM lineitem GROUP BY 1, 2""",
)
def price_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return prices.price_summary(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "day", F.col("l_discount") > 0.05, {"stores": "l_suppkey", "products": "l_partkey"})


WEIGHTED = "SELECT user_id, event_type, {figures} FROM (SELECT *, sum(w) OVER (PARTITION BY user_id, event_type ORDER BY v) AS cum, sum(w) OVER (PARTITION BY user_id, event_type) AS tot FROM (SELECT user_id, event_type, v, sum(least(hi, {to}) - greatest(lo, {at})) AS w FROM n WHERE v IS NOT NULL AND least(hi, {to}) > greatest(lo, {at}) GROUP BY 1, 2, 3)) GROUP BY 1, 2"
MIDDLE = "min(v) FILTER (WHERE cum >= 0.5 * tot) AS m, max(tot) AS days"


@query(
    "price_history",
    SERIES
    + f""", n AS (SELECT * FROM sp WHERE hi > lo),
g AS (SELECT user_id, event_type, {END} - min(lo) AS span, coalesce(CAST(sum(hi - lo) FILTER (WHERE v IS NOT NULL) AS DOUBLE), 0) AS known, CAST(sum(v * (hi - lo)) FILTER (WHERE v IS NOT NULL) AS DOUBLE) / CAST(sum(hi - lo) FILTER (WHERE v IS NOT NULL) AS DOUBLE) AS mean FROM n GROUP BY 1, 2),
o AS (SELECT n.user_id, n.event_type, sqrt(sum(pow(v - mean, 2) * (hi - lo)) / sum(hi - lo)) AS sd, max(v) AS high FROM n JOIN g USING (user_id, event_type) WHERE v IS NOT NULL GROUP BY 1, 2),
p AS (SELECT user_id, event_type, count(*) AS points, arg_max(v, sec) FILTER (WHERE v IS NOT NULL) AS latest FROM s GROUP BY 1, 2),
d AS (SELECT user_id, event_type, count(*) AS discounts FROM (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY sec) AS b FROM s WHERE v IS NOT NULL) WHERE b > 0 AND (v - b) * 10000 <= -500 * b GROUP BY 1, 2),
q AS ({WEIGHTED.format(figures="min(v) AS low, min(v) FILTER (WHERE cum >= 0.25 * tot) AS p25, min(v) FILTER (WHERE cum >= 0.5 * tot) AS median, min(v) FILTER (WHERE cum >= 0.75 * tot) AS p75", at=0, to=END)}),
x AS ({WEIGHTED.format(figures=MIDDLE, at=END - 8 * 86400, to=END)}), y AS ({WEIGHTED.format(figures=MIDDLE, at=END - 16 * 86400, to=END - 8 * 86400)}),
t AS (SELECT user_id, event_type, CAST(trunc((x.m - y.m) * 10000 / y.m) AS BIGINT) AS trend_bps FROM x JOIN y USING (user_id, event_type) WHERE x.days >= 7 * 86400 AND y.days >= 7 * 86400 AND y.m > 0)
SELECT user_id, event_type, points, span AS span_seconds, round(CASE WHEN span > 0 THEN 1 - known / span ELSE 0 END, 9) AS unavailable_share, low, p25, median, p75, high, latest, CASE WHEN mean > 0 THEN CAST(round(sd / mean * 10000) AS BIGINT) END AS cv_bps,
coalesce(discounts, 0) AS discounts, trend_bps, CASE WHEN trend_bps IS NULL THEN 'INSUFFICIENT_COVERAGE_7_DAYS_PER_WINDOW' ELSE 'DERIVED' END AS trend_status
FROM g LEFT JOIN o USING (user_id, event_type) LEFT JOIN p USING (user_id, event_type) LEFT JOIN d USING (user_id, event_type) LEFT JOIN q USING (user_id, event_type) LEFT JOIN t USING (user_id, event_type)""",
)
def price_history(spark, sf_dir):
    """The table spans a month, so the trend compares windows of eight days instead of ninety."""
    h = prices.price_history(series(spark, sf_dir), KEY, "sec", "v", F.lit(END), window_days=8)
    return h.withColumn("unavailable_share", F.round("unavailable_share", 9))


@query(
    "observed_prices",
    """WITH w AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, min_by(CAST(floor(value) AS BIGINT), event_id) AS v, min_by(event_id % 3 * 3000, event_id) AS len FROM events GROUP BY 1, 2),
s AS (SELECT *, a + len AS z, lag(a + len) OVER o AS pz, lag(v) OVER o AS pv FROM w WINDOW o AS (PARTITION BY user_id ORDER BY a, v)), c AS (SELECT user_id, count(DISTINCT CASE WHEN user_id % 7 = 0 AND event_type = 'click' THEN 'EUR' ELSE 'USD' END) > 1 AS mixed FROM events GROUP BY 1),
g AS (SELECT user_id, coalesce(bool_or(a < pz AND v <> pv), false) AS lapped, CAST(sum(len) AS BIGINT) AS observed, max(z) - min(a) AS span, max_by(v, a) AS latest FROM s GROUP BY 1),
n AS (SELECT user_id, v, sum(len) AS wt FROM w WHERE len > 0 GROUP BY 1, 2), k AS (SELECT *, sum(wt) OVER (PARTITION BY user_id ORDER BY v) AS cum, sum(wt) OVER (PARTITION BY user_id) AS tot FROM n),
q AS (SELECT k.user_id, min(v) AS low, min(v) FILTER (WHERE cum >= 0.25 * tot) AS p25, min(v) FILTER (WHERE cum >= 0.5 * tot) AS median, min(v) FILTER (WHERE cum >= 0.75 * tot) AS p75, max(v) AS high, coalesce(sum(wt) FILTER (WHERE v < latest), 0) AS below, max(tot) AS tot FROM k JOIN g ON g.user_id = k.user_id GROUP BY 1),
r AS (SELECT g.*, CASE WHEN lapped THEN 'OVERLAPPING_PRICE_WINDOWS' WHEN mixed THEN 'MORE_THAN_ONE_CURRENCY' END AS reason FROM g JOIN c USING (user_id)), f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'CONFLICT' WHEN observed = 0 THEN 'INSUFFICIENT_DURATION' ELSE 'DERIVED' END AS state FROM r)
SELECT user_id, state, reason, observed AS observed_seconds, greatest(0, span - observed) AS unobserved_seconds, CASE WHEN state = 'DERIVED' THEN low END AS low, CASE WHEN state = 'DERIVED' THEN p25 END AS p25, CASE WHEN state = 'DERIVED' THEN median END AS median,
CASE WHEN state = 'DERIVED' THEN p75 END AS p75, CASE WHEN state = 'DERIVED' THEN high END AS high, CASE WHEN state = 'DERIVED' THEN latest END AS latest, CASE WHEN state = 'DERIVED' THEN CAST(floor(below * 10000 / tot) AS BIGINT) END AS share_below_latest_bps FROM f LEFT JOIN q USING (user_id)""",
)
def observed_prices(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp")).alias("valid_at")
    one = ev.groupBy("user_id", at).agg(F.min_by(F.struct(F.floor("value").cast("long").alias("value"), (F.col("event_id") % 3 * 3000).alias("len")), "event_id").alias("w"))
    w = one.select("user_id", "w.value", "valid_at", (F.col("valid_at") + F.col("w.len")).alias("last_observed_at"))
    currency = F.when((F.col("user_id") % 7 == 0) & (F.col("event_type") == "click"), "EUR").otherwise("USD")
    return prices.observed_prices(w, ["user_id"], ev.select("user_id", currency.alias("currency")))


@query(
    "shares_vs_prior",
    f"""WITH c AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS k, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1), n AS (SELECT *, sum(k) OVER () AS kn, sum(b) OVER () AS bn FROM c),
w AS (SELECT event_type, k, (k / kn + {trend.Z**2 / 2} / kn) / (1 + {trend.Z**2} / kn) AS m, {trend.Z} * sqrt(k / kn * (1 - k / kn) / kn + {trend.Z**2 / 4} / kn / kn) / (1 + {trend.Z**2} / kn) AS h, (b / bn + {trend.Z**2 / 2} / bn) / (1 + {trend.Z**2} / bn) AS bm, {trend.Z} * sqrt(b / bn * (1 - b / bn) / bn + {trend.Z**2 / 4} / bn / bn) / (1 + {trend.Z**2} / bn) AS bh FROM n)
SELECT event_type AS label, k AS count, CASE WHEN m - h > bm + bh THEN 'HIGHER' WHEN m + h < bm - bh THEN 'LOWER' ELSE 'NOT_SEPARATED' END AS versus_prior FROM w""",
)
def shares_vs_prior(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), (F.col("ts") >= "2024-01-16").alias("now"))
    return trend.shares_vs_prior(ev.where("now"), ev.where("NOT now"), "label").select("label", "count", "versus_prior")


@query(
    "daily_growth_state",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d WHERE day < DATE '2024-01-30'),
       g AS (SELECT event_type, CAST(coalesce(sum(n) FILTER (WHERE k <= 3), 0) AS BIGINT) AS after, CAST(coalesce(sum(n) FILTER (WHERE k > 3), 0) AS BIGINT) AS before, count(*) = 6 AND max(day) - min(day) = 5 AS whole FROM r WHERE k <= 6 GROUP BY 1),
       x AS (SELECT *, unnest(range(0, before + after + 1)) AS i FROM g),
       t AS (SELECT event_type, before, after, whole, sum(term) FILTER (WHERE i >= after) AS rise, sum(term) FILTER (WHERE i <= after) AS fall FROM (SELECT *, exp(lgamma(before + after + 1) - lgamma(i + 1) - lgamma(before + after - i + 1) + (before + after) * ln(0.5)) AS term FROM x) GROUP BY 1, 2, 3, 4)
       SELECT event_type, before, after, CASE WHEN NOT whole THEN 'INSUFFICIENT_COMPLETE_DAYS' WHEN before + after = 0 THEN 'NO_MENTIONS_IN_EITHER_WINDOW' WHEN rise < 0.05 THEN 'RISING' WHEN fall < 0.05 THEN 'FALLING' ELSE 'NO_DETECTABLE_CHANGE' END AS state FROM t""",
)
def daily_growth_state(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("day < '2024-01-30'")
    return trend.daily_growth(d, ["event_type"], "day", "n")


@query("entity_recurrence", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS platforms, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3")
def entity_recurrence(spark, sf_dir):
    return trend.recurrence(table(spark, sf_dir, "events"), "user_id", "event_type", 3)


@query("evidence_grade", "SELECT l_suppkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'COMPLETE_BY_SOURCE' WHEN bool_or(l_returnflag = 'R') THEN 'INTERRUPTED' ELSE 'PARTIAL' END AS grade FROM lineitem GROUP BY 1")
def evidence_grade(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "N", "COMPLETE_BY_SOURCE").when(F.col("l_returnflag") == "R", "NETWORK_INTERRUPTED").otherwise("SAMPLED")
    return trend.evidence_grade(table(spark, sf_dir, "lineitem").withColumn("state", state), ["l_suppkey"], "state")


@query("decayed_weight", "SELECT user_id, round(sum(value * pow(2.0, -((1706745600 - epoch(ts)) / 86400.0))), 4) AS weight FROM events GROUP BY 1")
def decayed_weight(spark, sf_dir):
    age = F.lit(END) - F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") * trend.decay(age, F.lit(86_400))), 4).alias("weight"))


@query(
    "time_slices",
    """WITH n AS (SELECT n_nationkey, 1000000 AS a, 1000000 + n_nationkey * 50000 AS z, greatest(3600, CAST(ceil(n_nationkey * 50000 / 20.0) AS BIGINT)) AS w FROM nation), s AS (SELECT n_nationkey, a, z, w, unnest(range(0, 31)) AS i FROM n)
SELECT n_nationkey, i, greatest(a, z - (i + 1) * w) AS since, z - i * w AS until FROM s WHERE z - i * w > a""",
)
def time_slices(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1_000_000).cast("long").alias("a"), (F.lit(1_000_000) + F.col("n_nationkey") * 50_000).cast("long").alias("z"))
    width = trend.fitted_width(F.col("a"), F.col("z"), F.lit(60), F.lit(20))
    return n.select("n_nationkey", F.posexplode(trend.slices(F.col("a"), F.col("z"), width)).alias("i", "s")).select("n_nationkey", "i", "s.since", "s.until")
