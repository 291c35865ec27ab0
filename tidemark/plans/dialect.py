"""Queries over the dialect's scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dialect as d

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(
    "scalar_string",
    """SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, length(p_name) AS n, substr(p_name, 1, 3) AS head, substr(p_name, -3) AS tail,
       instr(p_name, 'a') AS at, replace(p_type, 'A', '_') AS swapped, trim(p_brand, 'B#0') AS trimmed, hex(encode(p_brand)) AS hx, p_name || '/' || p_brand AS both_,
       coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand, p_name ILIKE '%a%' AS has_a FROM part""",
)
def scalar_string(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        d.lower("p_name").alias("low"),
        F.char_length("p_name").cast("long").alias("n"),
        d.substr("p_name", 1, 3).alias("head"),
        d.substr("p_name", -3).alias("tail"),
        F.instr("p_name", "a").cast("long").alias("at"),
        d.replace("p_type", "A", "_").alias("swapped"),
        F.btrim("p_brand", F.lit("B#0")).alias("trimmed"),
        F.hex(F.col("p_brand").cast("binary")).alias("hx"),
        F.concat("p_name", F.lit("/"), "p_brand").alias("both_"),
        F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit("none")).alias("brand"),
        d.like("p_name", "%a%").alias("has_a"),
    )


@query(
    "scalar_math",
    """SELECT o_orderkey, (o_orderkey - 3000) // 7 AS q, (o_orderkey - 3000) % 7 AS r, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 5) END AS z,
       abs(o_orderkey - 3000) AS a, round(o_totalprice, 1) AS p, o_orderkey & 255 AS low8, o_orderkey << 3 AS up, -o_orderkey AS neg, ~o_orderkey AS inv,
       CASE WHEN o_orderkey IS NULL OR o_custkey IS NULL THEN NULL ELSE least(o_orderkey, o_custkey) END AS lo FROM orders""",
)
def scalar_math(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        d.int_divide(k - 3000, F.lit(7)).alias("q"),
        d.modulo(k - 3000, F.lit(7)).alias("r"),
        d.int_divide(k, c % 5).alias("z"),
        F.abs(k - 3000).alias("a"),
        d.round_half_away("o_totalprice", 1).alias("p"),
        k.bitwiseAND(255).alias("low8"),
        d.shift_left(k, F.lit(3)).alias("up"),
        (-k).alias("neg"),
        F.bitwise_not(k).alias("inv"),
        d.least(k, c).alias("lo"),
    )


@query(
    "scalar_case_null",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS band,
       c_acctbal IS NOT DISTINCT FROM NULL AS unknown_, if(c_acctbal > 0, c_acctbal, NULL) AS credit, nullif(c_nationkey, 3) AS nk FROM customer""",
)
def scalar_case_null(spark, sf_dir):
    b, s = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(s == "BUILDING", 1).when(s == "MACHINERY", 2).otherwise(0).alias("seg"),
        F.when(b < 0, "debt").when(b < 1000, "low").otherwise("ok").alias("band"),
        b.eqNullSafe(F.lit(None)).alias("unknown_"),
        F.when(b > 0, b).alias("credit"),
        F.nullif("c_nationkey", F.lit(3)).alias("nk"),
    )


@query(
    "scalar_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock, CAST(epoch(o_orderdate) AS BIGINT) AS unix, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS jd,
       strftime(o_orderdate, '%j') AS yday, strftime(o_orderdate, '%w') AS wday, strftime(o_orderdate, '%V') AS iso_week, strftime(o_orderdate, '%W') AS monday_week, strftime(o_orderdate, '%U') AS sunday_week,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS later,
       strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)), '%Y-%m-%d') AS next_month FROM orders""",
)
def scalar_date(spark, sf_dir):
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        d.strftime("%F", t).alias("day"),
        d.strftime("%T", t).alias("clock"),
        d.unix_epoch(t).alias("unix"),
        F.round(d.julian_day(t), 6).alias("jd"),
        d.strftime("%j", t).alias("yday"),
        d.strftime("%w", t).alias("wday"),
        d.strftime("%V", t).alias("iso_week"),
        d.strftime("%W", t).alias("monday_week"),
        d.strftime("%U", t).alias("sunday_week"),
        d.strftime("%F", d.modify(t, "start of month")).alias("month_start"),
        d.strftime("%F", d.modify(t, "+3 days")).alias("later"),
        d.strftime("%F", d.modify(t, "+1 month")).alias("next_month"),
    )


@query(
    "scalar_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
)
def scalar_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.json_extract("props", "$.k").cast("long").alias("k"), d.json_extract("props", "$.missing").alias("missing"))


@query(
    "scalar_cast_prefix",
    """SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(substr(p_brand, 7) || 'abc', '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS n,
       coalesce(TRY_CAST(nullif(regexp_extract(p_size || '.5kg', '^([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), 0.0) AS r, coalesce(TRY_CAST(nullif(regexp_extract(p_name, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS zero FROM part""",
)
def scalar_cast_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        d.int_prefix(F.concat(F.substring("p_brand", 7, 100), F.lit("abc"))).alias("n"),
        d.real_prefix(F.concat(F.col("p_size").cast("string"), F.lit(".5kg"))).alias("r"),
        d.int_prefix("p_name").alias("zero"),
    )


@query(
    "scalar_time_values",
    """WITH o AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS t, o_orderkey % 7 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('minute', t), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(t - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S')
WHEN 3 THEN strftime(TIMESTAMP '2000-01-01' + (t - date_trunc('day', t)), '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(date_trunc('day', t) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS read FROM o""",
)
def scalar_time_values(spark, sf_dir):
    """Order times written in seven forms and read again; the seventh is none."""
    from tidemark.functions.timevalue import time_value

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86_400).cast("decimal(18,6)"))).alias("t"))
    k = F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, d.strftime("%F", "t"))
        .when(k == 1, d.strftime("%FT%R", "t"))
        .when(k == 2, d.strftime("%F %T.000+02:30", "t"))
        .when(k == 3, d.strftime("%T", "t"))
        .when(k == 4, F.ceil(d.julian_day(F.date_trunc("day", "t").cast("timestamp_ntz"))).cast("string"))
        .when(k == 5, F.concat(d.strftime("%s", "t"), F.lit(".0")))
        .otherwise(d.strftime("%F %H", "t"))
    )
    read = time_value(F.col("text"), "auto")
    return o.withColumn("text", text).select("o_orderkey", d.strftime("%F %T", read).alias("read"))
