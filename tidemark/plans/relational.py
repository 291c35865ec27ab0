"""Relational queries over the star schema: filters, joins, aggregates, set operations, order and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(
    "agg_group_having",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc
       FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
)
def agg_group_having(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
    return g.where("n > 10")


@query(
    "scan_filter_project",
    """SELECT l_orderkey, l_linenumber, l_quantity AS qty, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem
       WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O')""",
)
def scan_filter_project(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = li.where(F.col("l_quantity").between(10, 20) & (F.col("l_discount") >= 0.05) & F.col("l_returnflag").isin("A", "R") & ~(F.col("l_linestatus") == "O"))
    return kept.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("one_row_source", "SELECT 1 + 1 AS two, 'x' AS x, CAST(NULL AS BIGINT) AS nothing")
def one_row_source(spark, sf_dir):
    return spark.range(1).select((F.lit(1) + F.lit(1)).alias("two"), F.lit("x").alias("x"), F.lit(None).cast("long").alias("nothing"))


@query(
    "join_inner",
    """SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name""",
)
def join_inner(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "join_left",
    """SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0.0) AS total
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
def join_left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    sums = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    j = c.join(sums, c.c_custkey == sums.o_custkey, "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


query.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey >= r_regionkey")
query.sql("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
query.sql("join_derived", "SELECT n_name, n FROM nation JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) AS s ON n_nationkey = s_nationkey")
query.sql("join_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
query.sql("join_anti_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
query.sql("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)")


@query(
    "join_correlated_count",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P') < 1
       AND o_orderstatus = 'O'""",
)
def join_correlated_count(spark, sf_dir):
    """Orders whose customer has fewer than one order in the leased state: counted once per customer, then joined."""
    o = table(spark, sf_dir, "orders")
    busy = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("busy"))
    j = o.where("o_orderstatus = 'O'").join(busy, "o_custkey", "left")
    return j.where(F.coalesce("busy", F.lit(0)) < 1).select("o_orderkey", "o_custkey")


query.sql(
    "scalar_subquery",
    "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1) AS first_region FROM customer",
)
query.sql(
    "agg_distinct",
    "SELECT l_shipmode_flag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines, min(l_partkey) AS lo, max(l_partkey) AS hi "
    "FROM (SELECT l_returnflag AS l_shipmode_flag, l_suppkey, l_linenumber, l_partkey FROM lineitem) AS x GROUP BY l_shipmode_flag",
)
query.sql(
    "agg_global_empty",
    "SELECT count(*) AS n, sum(l_quantity) AS s, coalesce(sum(l_quantity), 0.0) AS total, avg(l_quantity) AS a, min(l_partkey) AS lo FROM lineitem WHERE l_quantity < 0",
)
query.sql("agg_having_only", "SELECT count(*) AS n FROM part HAVING count(*) > 1")


@query(
    "agg_group_concat",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
)
def agg_group_concat(spark, sf_dir):
    names = F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey)")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"))


@query(
    "agg_bare_first",
    "SELECT o_custkey, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY o_custkey",
)
def agg_bare_first(spark, sf_dir):
    """Columns outside the grouping come from the group's first row, by row number."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return g.agg(F.count("*").alias("n"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"))


@query(
    "agg_optional_filters",
    "SELECT event_type, round(sum(value), 4) AS spent, count(*) AS calls FROM events WHERE ('click' IS NULL OR event_type <> 'click') AND (NULL IS NULL OR user_id = NULL) GROUP BY event_type",
)
def agg_optional_filters(spark, sf_dir):
    """A ledger sum: each condition holds only where its parameter is given."""
    e = table(spark, sf_dir, "events")
    for cond in (F.col("event_type") != "click", None):
        e = e if cond is None else e.where(cond)
    return e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("spent"), F.count("*").alias("calls"))


@query("agg_state_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def agg_state_pivot(spark, sf_dir):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(is_("F"), is_("O"), is_("P"))


@query(
    "agg_lower_median",
    """SELECT p_brand, count(*) AS n, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS median_size, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(DISTINCT p_type) AS kinds
       FROM part GROUP BY p_brand""",
)
def agg_lower_median(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand")
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size)").cast("long").alias("median_size")
    return g.agg(F.count("*").alias("n"), median, F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.countDistinct("p_type").alias("kinds"))


query.sql("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
query.sql("set_union_all", "SELECT p_size AS k FROM part UNION ALL SELECT l_linenumber FROM lineitem WHERE l_linenumber = 7")
query.sql("set_intersect", "SELECT p_size AS k FROM part INTERSECT SELECT l_linenumber FROM lineitem")
query.sql("set_except", "SELECT p_size AS k FROM part EXCEPT SELECT l_linenumber FROM lineitem")
query.sql("set_left_to_right", "SELECT k FROM ((SELECT p_size AS k FROM part UNION SELECT n_nationkey FROM nation) INTERSECT SELECT r_regionkey FROM region) AS x")
query.sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@query(
    "set_multiset_difference",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS removed, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added
       FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def set_multiset_difference(spark, sf_dir):
    from tidemark.operators.sets import multiset_difference

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return multiset_difference(o.where("o_orderstatus = 'F'").select("k"), o.where("o_orderstatus = 'O'").select("k"))


query.sql("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
query.sql("order_two_level_limit", "SELECT event_id, user_id FROM (SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) AS latest ORDER BY event_id LIMIT 100")
query.sql("event_log_tail", "SELECT event_id, event_type FROM events WHERE event_id > 4000 ORDER BY event_id LIMIT 100")


@query(
    "top3_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k <= 3",
)
def top3_per_group(spark, sf_dir):
    from tidemark.operators.ranking import top_per_key

    o = table(spark, sf_dir, "orders")
    return top_per_key(o, ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 3, "k").select("o_custkey", "o_orderkey", "o_totalprice", "k")


@query(
    "latest_per_key",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1",
)
def latest_per_key(spark, sf_dir):
    """The newest capture of each key; of equal ones the first that came. An aggregate, so it combines before the shuffle."""
    from tidemark.operators.ranking import latest

    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    "percent_rank_in_group",
    """SELECT p_brand, p_partkey, CASE WHEN n < 2 THEN 1.0 ELSE round(below / (n - 1.0), 6) END AS pr FROM (
         SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS below FROM part)""",
)
def percent_rank_in_group(spark, sf_dir):
    w = Window.partitionBy("p_brand")
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.count("*").over(w).alias("n"), F.percent_rank().over(w.orderBy("p_retailprice")).alias("r"))
    return p.select("p_brand", "p_partkey", F.when(F.col("n") < 2, 1.0).otherwise(F.round("r", 6)).alias("pr"))


@query(
    "cache_eviction",
    """WITH r AS (SELECT page_id, octet_length(encode(html)) AS bytes, sum(octet_length(encode(html))) OVER (ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM pages)
       SELECT page_id, CAST(bytes AS BIGINT) AS bytes FROM r WHERE run > 200000""",
)
def cache_eviction(spark, sf_dir):
    """What a cache of 200 000 bytes evicts, the smallest expiry (here the page id) first."""
    from tidemark.operators.ranking import evicted

    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return evicted(p, "bytes", "page_id", 200_000, ties=("bytes",)).select("page_id", "bytes")
