"""Changes and constraints as frames, over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dml

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

OLD = "(SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 3 <> 0)"
NEW = "(SELECT o_orderkey AS k, 'N' AS s, o_totalprice + 1 AS p FROM orders WHERE o_orderkey % 5 = 0)"


def _both(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return o.where("k % 3 <> 0"), o.where("k % 5 = 0").withColumns({"s": F.lit("N"), "p": F.col("p") + 1})


@query("insert_or_ignore", f"SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW} n WHERE k NOT IN (SELECT k FROM {OLD})")
def insert_or_ignore(spark, sf_dir):
    return dml.insert_or_ignore(*_both(spark, sf_dir), ["k"], "k")


@query("insert_or_replace", f"SELECT * FROM {OLD} o WHERE k NOT IN (SELECT k FROM {NEW}) UNION ALL SELECT * FROM {NEW}")
def insert_or_replace(spark, sf_dir):
    return dml.insert_or_replace(*_both(spark, sf_dir), ["k"], "k")


@query(
    "upsert",
    f"""SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.s WHEN n.k IS NOT NULL AND o.p > 100000 THEN n.s ELSE o.s END AS s,
        round(CASE WHEN o.k IS NULL THEN n.p WHEN n.k IS NOT NULL AND o.p > 100000 THEN o.p + n.p ELSE o.p END, 2) AS p FROM {OLD} o FULL JOIN {NEW} n ON o.k = n.k""",
)
def upsert(spark, sf_dir):
    old, new = _both(spark, sf_dir)
    u = dml.upsert(old, new, ["k"], {"s": F.col("excluded_s"), "p": F.col("p") + F.col("excluded_p")}, F.col("p") > 100000)
    return u.withColumn("p", F.round("p", 2))


@query("update_where", f"SELECT k, CASE WHEN s = 'F' AND p > 1000 THEN 'X' ELSE s END AS s, CASE WHEN s = 'F' AND p > 1000 THEN 0.0 ELSE p END AS p FROM {OLD}")
def update_where(spark, sf_dir):
    return dml.update(_both(spark, sf_dir)[0], (F.col("s") == "F") & (F.col("p") > 1000), {"s": F.lit("X"), "p": F.lit(0.0)})


@query("delete_where", f"SELECT * FROM {OLD} WHERE NOT coalesce(nullif(s, 'P') = 'O', false)")
def delete_where(spark, sf_dir):
    return dml.delete(_both(spark, sf_dir)[0], F.nullif("s", F.lit("P")) == "O")


@query("unique_violations", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return dml.unique_violations(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("foreign_key_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_key_orphans(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return dml.orphans(o.select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey").select("o_orderkey", "o_custkey")


@query("check_violations", "SELECT p_partkey FROM part WHERE NOT coalesce(nullif(p_size, 7) > 5, true)")
def check_violations(spark, sf_dir):
    return dml.failed_checks(table(spark, sf_dir, "part"), F.nullif("p_size", F.lit(7)) > 5).select("p_partkey")


@query("next_row_ids", "SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, s_name FROM supplier")
def next_row_ids(spark, sf_dir):
    ids = dml.with_next_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "id", "s_suppkey")
    return ids.select("id", "s_name")
