"""Trend queries over events: a type is a topic, a user a source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import trend as t
from tidemark.operators.ranking import quantiles

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

NOW, DAY = 1_706_659_200, 86_400
SEC = "CAST(floor(epoch(ts)) AS BIGINT)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("mention_windows", f"SELECT event_type, CAST(floor(({NOW} - {SEC}) / {DAY}.0) AS INTEGER) AS k, count(*) AS n FROM events WHERE {SEC} <= {NOW} AND {SEC} > {NOW} - {DAY} * 14 GROUP BY 1, 2")
def mention_windows(spark, sf_dir):
    return t.window_counts(events(spark, sf_dir), ["event_type"], "sec", DAY, NOW, 14)


@query(
    "wilson_shares",
    """SELECT event_type, k, n, round(greatest(0, (k * 1.0 / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n)), 9) AS lo,
       round(least(1, (k * 1.0 / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n)), 9) AS hi
       FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) AS k, count(*) AS n FROM events GROUP BY 1)""",
)
def wilson_shares(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    lo, hi = t.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("event_type", "k", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query(
    "growth_test",
    f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE {SEC} <= {NOW - 7 * DAY}) AS before, count(*) FILTER (WHERE {SEC} > {NOW - 7 * DAY}) AS after FROM events WHERE {SEC} <= {NOW} AND {SEC} > {NOW - 14 * DAY} GROUP BY 1),
x AS (SELECT user_id, before, after, i, exp(lgamma(before + after + 1) - lgamma(i + 1) - lgamma(before + after - i + 1) + (before + after) * ln(0.5)) AS term FROM (SELECT *, unnest(range(0, before + after + 1)) AS i FROM c)),
s AS (SELECT user_id, before, after, sum(term) FILTER (WHERE i >= after) AS rise, sum(term) FILTER (WHERE i <= after) AS fall FROM x GROUP BY 1, 2, 3)
SELECT user_id, before, after, CASE WHEN rise < 0.05 THEN 'RISING' WHEN fall < 0.05 THEN 'FALLING' ELSE 'NO_DETECTABLE_CHANGE' END AS state FROM s""",
)
def growth_test(spark, sf_dir):
    e = events(spark, sf_dir).where((F.col("sec") <= NOW) & (F.col("sec") > NOW - 14 * DAY))
    g = e.groupBy("user_id").agg(F.count_if(F.col("sec") <= NOW - 7 * DAY).alias("before"), F.count_if(F.col("sec") > NOW - 7 * DAY).alias("after"))
    week = F.lit(7 * DAY)
    return g.select("user_id", "before", "after", t.rate_state(F.col("before"), week, F.col("after"), week).alias("state"))


@query(
    "daily_growth",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d WHERE day < DATE '2024-01-30')
       SELECT event_type, CAST(sum(n) FILTER (WHERE k <= 3) AS BIGINT) AS after, CAST(sum(n) FILTER (WHERE k > 3) AS BIGINT) AS before FROM r WHERE k <= 6 GROUP BY 1 HAVING max(day) - min(day) = 5""",
)
def daily_growth(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    r = d.where("day < '2024-01-30'").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))).where("k <= 6")
    g = r.groupBy("event_type").agg(F.sum(F.when(F.col("k") <= 3, F.col("n"))).alias("after"), F.sum(F.when(F.col("k") > 3, F.col("n"))).alias("before"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    return g.where("span = 5").select("event_type", "after", "before")


SNAP = """WITH d AS (SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS at_, count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY 1, 2),
v AS (SELECT *, (n - lag(n) OVER w) / ((at_ - lag(at_) OVER w) / 3600.0) AS velocity, (at_ - lag(at_) OVER w) / 3600.0 AS h FROM d WINDOW w AS (PARTITION BY event_type ORDER BY at_)),
a AS (SELECT *, (velocity - lag(velocity) OVER w) / h AS acceleration, avg(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS persistence FROM v WINDOW w AS (PARTITION BY event_type ORDER BY at_)) """


def snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("at_")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sources"))
    return t.snapshots(d, ["event_type"], "at_", "n")


@query(
    "trend_score",
    SNAP + """SELECT event_type, at_, n, round(coalesce(0.3 * greatest(velocity, 0) / (1 + greatest(velocity, 0)), 0) + coalesce(0.15 * greatest(acceleration, 0) / (1 + greatest(acceleration, 0)), 0) + coalesce(0.15 * persistence, 0) + 0.1 * sources / (sources + 1), 6) AS score,
round(CASE WHEN velocity IS NULL THEN 0 ELSE 0.3 END + CASE WHEN acceleration IS NULL THEN 0 ELSE 0.15 END + CASE WHEN persistence IS NULL THEN 0 ELSE 0.15 END + 0.1, 6) AS coverage,
CASE WHEN n < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN acceleration > 0 THEN 'ACCELERATING' WHEN velocity < 0 THEN 'COOLING' WHEN persistence >= 0.75 THEN 'PERSISTENT' WHEN velocity > 0 THEN 'EMERGING' ELSE 'DISCOVERED' END AS state FROM a""",
)
def trend_score(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    parts = {"velocity": t.saturated(F.col("velocity")), "acceleration": t.saturated(F.col("acceleration")), "persistence": F.col("persistence"), "source_diversity": F.col("sources") / (F.col("sources") + 1)}
    parts = {k: (F.when(F.col(k).isNotNull(), v) if k in ("velocity", "acceleration") else v) for k, v in parts.items()}
    score, coverage = t.score(parts)
    return s.select("event_type", "at_", "n", F.round(score, 6).alias("score"), F.round(coverage, 6).alias("coverage"), t.state(F.col("n"), F.col("velocity"), F.col("acceleration"), F.col("persistence")).alias("state"))


@query("novelty", """SELECT a.event_type, count(*) AS seen, count(*) FILTER (WHERE b.user_id IS NULL) AS fresh FROM (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16') a
LEFT JOIN (SELECT DISTINCT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-16') b ON a.event_type = b.event_type AND a.user_id = b.user_id GROUP BY 1""")
def novelty(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = ["event_type", "user_id"]
    new, old = e.where("ts >= '2024-01-16'").select(key).distinct(), e.where("ts < '2024-01-16'").select(key).distinct().withColumn("old", F.lit(1))
    return new.join(old, key, "left").groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(F.col("old").isNull()).alias("fresh"))


@query("counter_delta", "SELECT a.user_id, max(greatest(b.n - a.n, b.v - a.v)) AS delta FROM (SELECT user_id, event_type, count(*) AS n, CAST(floor(sum(value)) AS BIGINT) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2) a JOIN (SELECT user_id, event_type, count(*) AS n, CAST(floor(sum(value)) AS BIGINT) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1")
def counter_delta(spark, sf_dir):
    """Sums of doubles that are whole numbers of cents: a whole sum comes out as n or just under it by the order of addition.
    So values are added one by one in the order of the file's rows, as the SQL does on one thread, and not task by task."""
    late = F.col("ts") >= "2024-01-16"
    e = table(spark, sf_dir, "events").where(late.isNotNull() & F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
    e = e.select("user_id", "event_type", late.alias("late"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    key = ["user_id", "event_type", "late"]
    so_far = Window.partitionBy(key).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = e.select(*key, F.count("*").over(so_far).alias("n"), F.sum("value").over(so_far).alias("v"))
    half = sums.groupBy(key).agg(F.max("n").alias("n"), F.floor(F.max_by("v", "n")).alias("v"))
    x = half.groupBy("user_id", "event_type").agg(*[F.max(F.when(F.col("late") == i, F.col(c))).alias(f"{c}{int(i)}") for i in (False, True) for c in ("n", "v")])
    return x.where("n0 > 0 AND n1 > 0").groupBy("user_id").agg(F.max(F.greatest(F.col("n1") - F.col("n0"), F.col("v1") - F.col("v0"))).alias("delta"))


@query("dispersion", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""")
def dispersion(spark, sf_dir):
    """With exact quantiles, by selection: no group's values are held in one place."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    q = quantiles(e, ["event_type"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return g.join(q, "event_type").select("event_type", "n", "mean", "sd", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90")], "lo", "hi")


@query(
    "growth_probabilities",
    f"""WITH c AS (SELECT event_type, user_id % 10 AS part, count(*) FILTER (WHERE {SEC} <= {NOW - 7 * DAY}) AS before, count(*) FILTER (WHERE {SEC} > {NOW - 7 * DAY}) AS after FROM events WHERE {SEC} <= {NOW} AND {SEC} > {NOW - 17 * DAY} GROUP BY 1, 2),
x AS (SELECT *, unnest(range(0, before + after + 1)) AS i FROM c),
s AS (SELECT event_type, part, before, after, exp(lgamma(before + after + 1) - lgamma(i + 1) - lgamma(before + after - i + 1) + i * ln(7 / 17.0) + (before + after - i) * ln(10 / 17.0)) AS term, i FROM x)
SELECT event_type, part, before, after, round(sum(term) FILTER (WHERE i >= after), 7) AS rise, round(sum(term) FILTER (WHERE i <= after), 7) AS fall FROM s GROUP BY 1, 2, 3, 4""",
)
def growth_probabilities(spark, sf_dir):
    """The exact test's probabilities, of windows of different length."""
    e = events(spark, sf_dir).where((F.col("sec") <= NOW) & (F.col("sec") > NOW - 17 * DAY))
    g = e.groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.count_if(F.col("sec") <= NOW - 7 * DAY).alias("before"), F.count_if(F.col("sec") > NOW - 7 * DAY).alias("after"))
    rise, fall = t.binomial_tails(F.col("before") + F.col("after"), F.col("after"), F.lit(7 / 17))
    return g.select("event_type", "part", "before", "after", F.round(rise, 7).alias("rise"), F.round(fall, 7).alias("fall"))
