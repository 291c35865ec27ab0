"""Temporal queries over events: a user's events of a type are a step series of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import temporal as t

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: 2024-02-01 in seconds; the end of the driver's events.
END = 1_706_745_600
#: One row per user, type and second, its least event; values in whole cents.
SERIES = f"""WITH s AS (SELECT user_id, event_type, sec, CASE WHEN v % 10 = 0 THEN NULL ELSE v END AS v FROM (
  SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) ORDER BY event_id) AS k FROM events) WHERE k = 1),
sp AS (SELECT user_id, event_type, sec AS lo, least(coalesce(lead(sec) OVER (PARTITION BY user_id, event_type ORDER BY sec), {END}), {END}) AS hi, v FROM s) """
KEY = ["user_id", "event_type"]


def series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(*KEY, "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    one = e.groupBy(*KEY, "sec").agg(F.min_by("v", "event_id").alias("v"))
    return one.withColumn("v", F.when(F.col("v") % 10 != 0, F.col("v")))


def spans(spark, sf_dir):
    return t.step_spans(series(spark, sf_dir), KEY, "sec", "v", F.lit(END))


@query("step_spans", SERIES + 'SELECT user_id, event_type, lo AS start, hi AS "end", v AS value FROM sp WHERE hi > lo')
def step_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query(
    "weighted_quantiles",
    SERIES
    + """, w AS (SELECT user_id, event_type, v, sum(hi - lo) AS w FROM sp WHERE hi > lo AND v IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id, event_type ORDER BY v) AS cum, sum(w) OVER (PARTITION BY user_id, event_type) AS tot FROM w)
SELECT user_id, event_type, min(v) FILTER (WHERE cum >= 0) AS low, min(v) FILTER (WHERE cum >= 0.25 * tot) AS p25, min(v) FILTER (WHERE cum >= 0.5 * tot) AS median, min(v) FILTER (WHERE cum >= 0.75 * tot) AS p75,
CAST(sum(w) AS BIGINT) AS seconds FROM c GROUP BY 1, 2""",
)
def weighted_quantiles(spark, sf_dir):
    return t.weighted_quantiles(spans(spark, sf_dir), KEY, {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75})


@query(
    "price_history_metrics",
    SERIES
    + f"""SELECT user_id, event_type, CAST(sum(hi - lo) AS BIGINT) AS seconds, round(sum(CASE WHEN v IS NULL THEN hi - lo ELSE 0 END) / sum(hi - lo), 6) AS unavailable,
round(sum(v * (hi - lo)) / nullif(sum(CASE WHEN v IS NOT NULL THEN hi - lo ELSE 0 END), 0), 3) AS mean, max_by(v, lo) AS latest_or_null
FROM sp WHERE hi > lo AND hi <= {END} GROUP BY 1, 2""",
)
def price_history_metrics(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("w", F.col("end") - F.col("start"))
    have = F.sum(F.when(F.col("value").isNotNull(), F.col("w")).otherwise(0))
    return s.groupBy(*KEY).agg(
        F.sum("w").alias("seconds"),
        F.round(F.sum(F.when(F.col("value").isNull(), F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("unavailable"),
        F.round(F.sum(F.col("value") * F.col("w")) / F.nullif(have, F.lit(0)), 3).alias("mean"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("start"))).alias("latest_or_null"),
    )


@query(
    "discount_events",
    SERIES + """, p AS (SELECT user_id, event_type, sec AS ts, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY sec) AS before, v AS after FROM s WHERE v IS NOT NULL)
SELECT * FROM p WHERE (after - before) * 10000 <= -500 * before""",
)
def discount_events(spark, sf_dir):
    return t.discounts(series(spark, sf_dir), KEY, "sec", "v")


WINDOWS = """, o AS (SELECT *, CASE WHEN lag(b) OVER w IS NOT DISTINCT FROM b THEN 0 ELSE 1 END AS ch FROM (SELECT user_id, event_type, sec, v // 2000 AS b FROM s WHERE v IS NOT NULL) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY sec)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id, event_type ORDER BY sec) AS run FROM o),
g AS (SELECT user_id, event_type, min(b) AS value, min(sec) AS valid_at, max(sec) AS last_observed_at FROM r GROUP BY user_id, event_type, run),
win AS (SELECT user_id, event_type, value, valid_at, lead(valid_at) OVER (PARTITION BY user_id, event_type ORDER BY valid_at) AS invalid_at, last_observed_at FROM g) """


def windows(spark, sf_dir):
    banded = series(spark, sf_dir).withColumn("b", F.floor(F.col("v") / 2000).cast("long"))
    return t.scd2(banded, KEY, "sec", "b")


@query("scd2_windows", SERIES + WINDOWS + "SELECT * FROM win")
def scd2_windows(spark, sf_dir):
    return windows(spark, sf_dir)


@query(
    "fact_as_of",
    SERIES
    + WINDOWS
    + """, q AS (SELECT DISTINCT user_id, event_type, tick FROM s, (VALUES (1704500000), (1705500000), (1706500000)) AS x(tick)),
h AS (SELECT q.user_id, q.event_type, q.tick, count(DISTINCT value) AS n, min(value) AS value, max(last_observed_at) AS seen, bool_or(invalid_at IS NULL) AS open FROM q LEFT JOIN win ON q.user_id = win.user_id AND q.event_type = win.event_type AND valid_at <= tick AND (invalid_at IS NULL OR tick < invalid_at) GROUP BY 1, 2, 3)
SELECT user_id, event_type, CAST(tick AS BIGINT) AS tick, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 0 THEN 'UNKNOWN' WHEN tick <= seen THEN 'OBSERVED' WHEN open THEN 'NOT_OBSERVED_SINCE' ELSE 'CHANGE_TIME_UNKNOWN' END AS state FROM h""",
)
def fact_as_of(spark, sf_dir):
    times = F.explode(F.array(*[F.lit(x).cast("long") for x in (1704500000, 1705500000, 1706500000)])).alias("tick")
    questions = series(spark, sf_dir).select(*KEY).distinct().select(*KEY, times)
    return t.as_of(windows(spark, sf_dir), questions, KEY, "tick")


@query(
    "carry_forward",
    SERIES + """, c AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS carried, max(CASE WHEN v IS NOT NULL THEN sec END) OVER w AS seen FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY sec ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_type, sec, v, carried, CASE WHEN v IS NULL THEN min(CASE WHEN v IS NULL THEN sec END) OVER (PARTITION BY user_id, event_type, seen ORDER BY sec ROWS UNBOUNDED PRECEDING) END AS unobserved_since FROM c""",
)
def carry_forward(spark, sf_dir):
    return t.carry_forward(series(spark, sf_dir), KEY, "sec", "v").select(*KEY, "sec", "v", "carried", "unobserved_since")


@query(
    "interval_union_coverage",
    SERIES + """, i AS (SELECT user_id, sec AS lo, sec + 20000 AS hi FROM s), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT user_id, CAST(sum(greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS BIGINT) AS covered, count(*) FILTER (WHERE lo > seen) AS gaps FROM m GROUP BY 1""",
)
def interval_union_coverage(spark, sf_dir):
    i = series(spark, sf_dir).select("user_id", F.col("sec").alias("lo"), (F.col("sec") + 20000).alias("hi"))
    return t.union_coverage(i, ["user_id"], "lo", "hi")


@query(
    "rank_velocity",
    SERIES + f""", g AS (SELECT user_id, event_type, d, {END} - d * 86400 - 1 AS tick, v FROM sp, range(0, 15) AS x(d) WHERE hi > lo AND lo <= {END} - d * 86400 - 1 AND {END} - d * 86400 - 1 < hi AND v > 0),
l AS (SELECT *, ln(v) AS lv, CASE WHEN tick - lag(tick) OVER w = 86400 THEN ln(v) - lag(ln(v)) OVER w END AS step FROM g WINDOW w AS (PARTITION BY user_id, event_type ORDER BY tick)),
e AS (SELECT user_id, event_type, count(*) AS n, (max(tick) - min(tick)) / 86400.0 AS d, arg_min(lv, tick) AS a, arg_max(lv, tick) AS b, stddev_samp(step) AS vol FROM l GROUP BY 1, 2)
SELECT user_id, event_type, n, round(CASE WHEN d > 0 THEN (b - a) / d END, 6) AS velocity, round(vol, 6) AS volatility,
CASE WHEN d = 0 THEN 'UNKNOWN' WHEN (b - a) / d < -0.005 THEN 'IMPROVING' WHEN (b - a) / d > 0.005 THEN 'DECLINING' ELSE 'STABLE' END AS direction FROM e""",
)
def rank_velocity(spark, sf_dir):
    r = t.rank_velocity(t.daily_samples(spans(spark, sf_dir), KEY, F.lit(END), 14), KEY)
    return r.withColumns({"velocity": F.round("velocity", 6), "volatility": F.round("volatility", 6)})


@query(
    "rank_persistence",
    """WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM p), g AS (SELECT user_id, run, min(day) AS lo, max(day) AS hi FROM r GROUP BY 1, 2),
k AS (SELECT user_id, min(lo) AS first, max(hi) AS hi, count(*) - 1 AS re_entries, arg_max(hi - lo + 1, hi) AS streak FROM g GROUP BY 1)
SELECT user_id, m - first + 1 AS captures, re_entries, streak, CASE WHEN first = m THEN 'NEW_ON_LIST' WHEN re_entries > 0 AND streak = 1 THEN 'RE_ENTERED' ELSE 'SUSTAINED' END AS state FROM k, (SELECT max(day) AS m FROM p) WHERE hi = m""",
)
def rank_persistence(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return t.rank_persistence(e.select("user_id", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day")), "user_id", "day")


@query(
    "alert_conditions",
    SERIES + """, m AS (SELECT user_id, event_type, sec, v, v < 2500 AS met, lag(v < 2500) OVER (PARTITION BY user_id, event_type ORDER BY sec) AS was FROM s WHERE v IS NOT NULL)
SELECT user_id, event_type, sec, v FROM m WHERE met AND NOT coalesce(was, false)""",
)
def alert_conditions(spark, sf_dir):
    return t.edge_triggered(series(spark, sf_dir).where("v IS NOT NULL"), KEY, "sec", F.col("v") < 2500)


@query(
    "range_overlap_neighbours",
    """WITH i AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS hi, value FROM events)
SELECT user_id, event_id FROM (SELECT *, lead(lo) OVER w AS nlo, lead(value) OVER w AS nv FROM i WINDOW w AS (PARTITION BY user_id ORDER BY lo, event_id)) WHERE nlo < hi AND nv <> value""",
)
def range_overlap_neighbours(spark, sf_dir):
    from pyspark.sql import Window

    i = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo"), "value")
    w = Window.partitionBy("user_id").orderBy("lo", "event_id")
    n = i.withColumns({"nlo": F.lead("lo").over(w), "nv": F.lead("value").over(w)})
    return n.where("nlo < lo + 7200 AND nv <> value").select("user_id", "event_id")


@query(
    "observed_statistics",
    SERIES
    + WINDOWS
    + """, sp2 AS (SELECT user_id, event_type, value, valid_at, greatest(coalesce(last_observed_at, valid_at), valid_at) - valid_at AS w FROM win),
l AS (SELECT user_id, event_type, arg_max(value, valid_at) AS latest FROM sp2 GROUP BY 1, 2), v AS (SELECT user_id, event_type, value, sum(w) AS w FROM sp2 WHERE w > 0 GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id, event_type ORDER BY value) AS cum, sum(w) OVER (PARTITION BY user_id, event_type) AS tot FROM v)
SELECT user_id, event_type, min(value) FILTER (WHERE cum >= 0) AS low, min(value) FILTER (WHERE cum >= 0.25 * tot) AS p25, min(value) FILTER (WHERE cum >= 0.5 * tot) AS median, min(value) FILTER (WHERE cum >= 0.75 * tot) AS p75, min(value) FILTER (WHERE cum >= tot) AS high,
any_value(latest) AS latest, CAST(max(tot) AS BIGINT) AS seconds, CAST(coalesce(sum(w) FILTER (WHERE value < latest), 0) * 10000 // max(tot) AS BIGINT) AS share_below_latest_bps FROM c JOIN l USING (user_id, event_type) GROUP BY 1, 2""",
)
def observed_statistics(spark, sf_dir):
    return t.observed_statistics(windows(spark, sf_dir), KEY)


@query(
    "change_events",
    """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind FROM events),
k AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(kind) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS across_gap FROM s)
SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, 'kind' AS field, before, kind AS after, across_gap FROM k WHERE before IS NOT NULL AND kind IS NOT NULL AND before <> kind""",
)
def change_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"))
    c = t.changes(e, ["user_id"], "ts", ["kind"])
    return c.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "field", "before", "after", "across_gap")
