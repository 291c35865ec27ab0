"""Named operations: ledgers, routing, coverage, paging, merges and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import temporal

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

query.sql("budget_month_to_date", "SELECT event_type, round(sum(value), 4) AS spent FROM events WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-17 10:00:00') AND ts < TIMESTAMP '2024-01-17 10:00:00' GROUP BY event_type")
query.sql("budget_gate", "SELECT user_id, count(*) <= 80 AND sum(value) <= 4000 AND max(value) <= 99.9 AS allowed FROM events GROUP BY user_id")
query.sql("provider_calls", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
query.sql(
    "provider_routing",
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'NO_BUDGET' WHEN s_nationkey > 20 THEN 'WRONG_MARKET' ELSE 'ELIGIBLE' END AS reason, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, s_suppkey) AS place FROM supplier",
)
query.sql("runs_latest", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
query.sql("candidates_verified", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) ORDER BY p_partkey DESC LIMIT 500")
query.sql("graph_verified_edges", "SELECT l_partkey AS a, l_suppkey AS b, count(*) AS evidence FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_partkey, l_suppkey")
query.sql("completeness_by_stage", "SELECT event_type, count(*) AS calls, count(CASE WHEN value > 50 THEN 1 END) AS live, count(CASE WHEN value <= 50 THEN 1 END) AS cached, min(value) > 0 AS all_known FROM events GROUP BY event_type")
query.sql("compare_side_by_side", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_partkey IN (1, 5, 9, 20)")


@query("cache_hit_ratio", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, round(count(*) FILTER (WHERE event_type = 'view') * 1.0 / nullif(count(*) FILTER (WHERE event_type <> 'purchase'), 0), 6) AS ratio FROM events GROUP BY 1")
def cache_hit_ratio(spark, sf_dir):
    """Ratios are null where nothing was counted."""
    hits, calls = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") != "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(hits.alias("hits"), F.round(F.try_divide(hits, calls), 6).alias("ratio"))


@query("list_paging", "SELECT user_id, list_slice(list_sort(list(event_id)), 3, 5) AS page, count(*) AS total FROM events GROUP BY 1")
def list_paging(spark, sf_dir):
    """Part of a list, by offset and limit, and how long it is."""
    from pyspark.sql import Window

    # Only the page's rows are collected, however long the list.
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    ranked = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 5")
    page = ranked.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("k") >= 3, F.col("event_id")))).alias("page"))
    return page.join(e.groupBy("user_id").agg(F.count("*").alias("total")), "user_id")


@query("lead_merge", "SELECT p_type AS lead, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, count(*) AS n FROM part GROUP BY 1")
def lead_merge(spark, sf_dir):
    """Leads with the same query are one; their evidence is united."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("lead")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.count("*").alias("n"))


@query(
    "supersession",
    """WITH w AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS valid_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) + 40000 END AS invalid_at FROM events),
       n AS (SELECT *, min(valid_at) OVER (PARTITION BY user_id ORDER BY valid_at RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM w)
       SELECT user_id, event_id, valid_at, CASE WHEN later < coalesce(invalid_at, later + 1) THEN later ELSE invalid_at END AS invalid_at FROM n""",
)
def supersession(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("valid_at"))
    w = e.withColumn("invalid_at", F.when(F.col("event_id") % 3 != 0, F.col("valid_at") + 40000))
    return temporal.supersede(w, ["user_id"])


@query(
    "trend_triggers",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mood FROM events GROUP BY 1, 2), p AS (SELECT *, lag(n) OVER w AS pn, lag(mood) OVER w AS pm FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
       f AS (SELECT event_type, day, CASE WHEN n >= 1.2 * pn THEN 'VOLUME_SPIKE' END AS a, CASE WHEN mood <= pm - 5 THEN 'SENTIMENT_DROP' END AS b, CASE WHEN n <= 0.8 * pn THEN 'COOLING' END AS c FROM p)
       SELECT event_type, strftime(day, '%Y-%m-%d') AS day, name FROM (SELECT event_type, day, unnest([a, b, c]) AS name FROM f) WHERE name IS NOT NULL""",
)
def trend_triggers(spark, sf_dir):
    """Which conditions hold against the snapshot before."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("mood"))
    w = Window.partitionBy("event_type").orderBy("day")
    p = d.withColumns({"pn": F.lag("n").over(w), "pm": F.lag("mood").over(w)})
    names = F.array(
        F.when(F.col("n") >= 1.2 * F.col("pn"), "VOLUME_SPIKE"),
        F.when(F.col("mood") <= F.col("pm") - 5, "SENTIMENT_DROP"),
        F.when(F.col("n") <= 0.8 * F.col("pn"), "COOLING"),
    )
    return p.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(F.array_compact(names)).alias("name"))


@query("population_coverage", """WITH s AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY event_type ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
c AS (SELECT event_type, CAST(sum(greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS BIGINT) AS covered, max(hi) - min(lo) AS span, count(*) FILTER (WHERE lo > seen) AS gaps FROM m GROUP BY 1)
SELECT event_type, covered, gaps, CASE WHEN covered = span THEN 'COMPLETE' WHEN covered * 2 >= span THEN 'PARTIAL' ELSE 'INTERRUPTED' END AS state FROM c""")
def population_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo")).withColumn("hi", F.col("lo") + 600)
    span = s.groupBy("event_type").agg((F.max("hi") - F.min("lo")).alias("span"))
    c = temporal.union_coverage(s, ["event_type"], "lo", "hi").join(span, "event_type")
    state = F.when(F.col("covered") == F.col("span"), "COMPLETE").when(F.col("covered") * 2 >= F.col("span"), "PARTIAL").otherwise("INTERRUPTED")
    return c.select("event_type", "covered", "gaps", state.alias("state"))


@query("table_info", "SELECT * FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) AS x(position, name)")
def table_info(spark, sf_dir):
    """The columns of a table, in order."""
    fields = table(spark, sf_dir, "nation").schema.names
    return spark.createDataFrame(list(enumerate(fields)), "position int, name string")


@query("add_column_default", "SELECT r_regionkey, r_name, 'none' AS note FROM region")
def add_column_default(spark, sf_dir):
    return table(spark, sf_dir, "region").withColumn("note", F.lit("none"))
