"""Identity, money and decisions over parts, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity as i

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _digits(code: str, odd: int) -> str:
    return f"list_sum(list_transform(range(1, length({code}) + 1), lambda j: CAST(substr(reverse({code}), CAST(j AS BIGINT), 1) AS BIGINT) * CASE WHEN j % 2 = {odd} THEN 3 ELSE 1 END))"


@query("gtin_checksum", f"WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 10 AS VARCHAR), 13, '0') AS code FROM part) SELECT p_partkey, CASE WHEN {_digits('code', 0)} % 10 = 0 THEN lpad(code, 14, '0') END AS gtin FROM c")
def gtin_checksum(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 7919 + 10).cast("string"), 13, "0")
    return table(spark, sf_dir, "part").select("p_partkey", i.gtin14(code).alias("gtin"))


@query(
    "identity_resolve",
    """WITH p AS (SELECT p_partkey, p_brand || '|' || p_type AS key, p_size, p_retailprice FROM part)
       SELECT key, count(*) AS members, min(p_partkey) AS first, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS size, count(DISTINCT p_size) > 1 AS size_conflict FROM p GROUP BY key""",
)
def identity_resolve(spark, sf_dir):
    """Rows of one identity are one entity; a field on which they differ is null, and marked."""
    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("|", "p_brand", "p_type"))
    n = F.count_distinct("p_size")
    return p.groupBy("key").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first"), F.when(n == 1, F.min("p_size")).alias("size"), (n > 1).alias("size_conflict"))


@query("money_minor", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS usd, CASE WHEN round(o_totalprice * 100) % 100 = 0 THEN CAST(round(o_totalprice) AS BIGINT) END AS jpy FROM orders")
def money_minor(spark, sf_dir):
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", i.minor_units(v, F.lit("USD")).alias("usd"), i.minor_units(v, F.lit("JPY")).alias("jpy"))


UNIT = """WITH u AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 60 / l_quantity) AS BIGINT) AS landed FROM lineitem),
c AS (SELECT *, (price * 1500 + 5000) // 10000 AS referral, price - landed - (price * 1500 + 5000) // 10000 - 300 AS contribution FROM u) """


@query(
    "economics_unit",
    UNIT + """SELECT l_orderkey, l_linenumber, referral, contribution, contribution * units - 5000 AS profit, landed * units + 5000 AS cash, CASE WHEN contribution > 0 THEN (4999 + contribution) // contribution END AS break_even,
CAST(trunc((contribution * units - 5000) * 10000 / (landed * units + 5000)) AS BIGINT) AS roi_bps FROM c""",
)
def economics_unit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    u = li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("price"), F.col("l_quantity").cast("long").alias("units"), F.round(F.col("l_extendedprice") * 60 / F.col("l_quantity")).cast("long").alias("landed"))
    c = u.withColumn("referral", i.half_up_bps(F.col("price"), F.lit(1500))).withColumn("contribution", F.col("price") - F.col("landed") - F.col("referral") - 300)
    profit, cash = F.col("contribution") * F.col("units") - 5000, F.col("landed") * F.col("units") + 5000
    even = F.when(F.col("contribution") > 0, F.ceil(F.lit(5000) / F.col("contribution")))
    return c.select("l_orderkey", "l_linenumber", "referral", "contribution", profit.alias("profit"), cash.alias("cash"), even.alias("break_even"), (profit * 10000 / cash).cast("long").alias("roi_bps"))


@query("uncertainty_bounds", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice * 90) AS BIGINT) - p_size * 300 END AS profit_min, CAST(round(p_retailprice * 110) AS BIGINT) - CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 100 END AS profit_max FROM part")
def uncertainty_bounds(spark, sf_dir):
    """Bounds of profit: the best case leaves unknown costs out, the worst is unknown with any of them."""
    cost = F.when(F.col("p_size") % 7 != 0, F.struct((F.col("p_size") * 100).alias("min"), (F.col("p_size") * 300).alias("max")))
    lo, hi = F.round(F.col("p_retailprice") * 90).cast("long"), F.round(F.col("p_retailprice") * 110).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (lo - cost["max"]).alias("profit_min"), (hi - F.coalesce(cost["min"], F.lit(0))).alias("profit_max"))


@query("decision_ladder", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'REJECTED' WHEN s_nationkey % 2 = 0 AND s_acctbal > 1000 THEN 'SHORTLISTED' WHEN s_suppkey % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN s_suppkey % 3 = 0 THEN 'SCREENED' ELSE 'VALIDATING' END AS decision FROM supplier")
def decision_ladder(spark, sf_dir):
    some = lambda *xs: F.filter(F.array(*xs), lambda v: v.isNotNull())
    rejected = some(F.when(F.col("s_acctbal") < 0, "DEBT"))
    missing = some(F.when(F.col("s_nationkey") % 2 != 0, "SITE"), F.when(F.col("s_acctbal") <= 1000, "FUNDS"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", i.decision(rejected, missing, F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") % 3 == 0).alias("decision"))


@query("offers_by_code", "SELECT l_partkey AS code, count(*) AS listings, count(DISTINCT l_suppkey) AS sellers, min(l_extendedprice) AS lo, quantile_disc(l_extendedprice, 0.5) AS median, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def offers_by_code(spark, sf_dir):
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("code")).agg(F.count("*").alias("listings"), F.count_distinct("l_suppkey").alias("sellers"), F.min("l_extendedprice").alias("lo"), median.alias("median"), F.max("l_extendedprice").alias("hi"))


@query("field_completeness", "SELECT c_mktsegment, round(avg((CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END + 1) / 3.0), 6) AS complete FROM customer GROUP BY 1")
def field_completeness(spark, sf_dir):
    known = [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")), F.col("c_name")]
    share = sum((k.isNotNull().cast("int") for k in known), F.lit(0)) / len(known)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(share), 6).alias("complete"))


@query("brand_shares", "SELECT p_brand, count(*) AS n, count(*) * 10000 // (SELECT count(*) FROM part) AS bps FROM part GROUP BY 1")
def brand_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    total = p.agg(F.count("*").alias("total"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("p_brand", "n", F.floor(F.col("n") * 10000 / F.col("total")).alias("bps"))


@query("snapshot_diff", """WITH a AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS p FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS s, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS p FROM part WHERE p_partkey % 9 <> 0)
SELECT coalesce(a.k, b.k) AS k, 'size' AS field, CAST(a.s AS VARCHAR) AS before, CAST(b.s AS VARCHAR) AS after FROM a FULL JOIN b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s
UNION ALL SELECT coalesce(a.k, b.k), 'price', CAST(a.p AS VARCHAR), CAST(b.p AS VARCHAR) FROM a FULL JOIN b ON a.k = b.k WHERE a.p IS DISTINCT FROM b.p""")
def snapshot_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    a = p.where("k % 4 <> 0")
    b = p.where("k % 9 <> 0").withColumns({"size": F.when(F.col("k") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")), "price": F.when(F.col("k") % 10 != 0, F.col("price"))})
    j = a.alias("a").join(b.alias("b"), "k", "full_outer")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after")) for c in ("size", "price")])).alias("d")
    return j.select("k", fields).select("k", "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


@query("url_canonical", r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]+)', 1)) AS h, regexp_extract(u, '^[A-Za-z]+://[^/?]+([^?]*)', 1) AS pa, regexp_extract(u, '\?(.*)$', 1) AS q FROM u),
f AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: string_split(x, '=')[1] <> 'ref')), '&') AS k FROM p)
SELECT page_id, c AS url, sha256(c) AS id FROM (SELECT page_id, s || '://' || h || CASE WHEN pa = '' THEN '/' ELSE pa END || CASE WHEN k = '' THEN '' ELSE '?' || k END AS c FROM f)""")
def url_canonical(spark, sf_dir):
    c = i.canonical_url("url", tracking=("ref",), sort_query=True)
    return table(spark, sf_dir, "pages").select("page_id", c.alias("url"), F.sha2(c, 256).alias("id"))
