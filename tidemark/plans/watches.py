"""Watches over the event log, and workers' reports on leased pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import frontier
from tidemark.storage import new_folder
from tidemark.streaming import watches

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: Seconds of a lease and between two results, at the pace of the event table.
LEASE, INTERVAL = 21_600, 10_800


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a watch: views and clicks are claims under the event's number, other events results under the token of
    the claim before, or of the one before that where the number is divisible by 4 (a worker that was overtaken)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").isin("view", "click").alias("claim"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = e.withColumn("older", F.last(F.when(F.col("claim"), F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.last(F.when(F.col("claim"), F.struct("event_id", "older")), ignorenulls=True).over(w)
    token = F.when(F.col("claim"), F.col("event_id")).otherwise(F.when(F.col("event_id") % 4 == 0, last["older"]).otherwise(last["event_id"]))
    value = F.when(~F.col("claim") & (F.col("event_id") % 5 != 0), F.floor(F.col("value") / 50).cast("double"))
    return e.select(F.col("user_id").alias("watch_id"), F.col("event_id").alias("seq"), "at", F.when(F.col("claim"), "CLAIM").otherwise("FINISH").alias("kind"), token.alias("token"), (F.col("event_type") != "error").alias("ok"), value.alias("value"))


def _published(spark: SparkSession, sf_dir: str):
    folder = new_folder(spark, "watches")
    _log(spark, sf_dir).write.parquet(f"{folder}/log")
    return watches.publish(spark.readStream.schema(watches.LOG).parquet(f"{folder}/log"), f"{folder}/tables", INTERVAL, LEASE)


STEPS = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_type IN ('view', 'click') AS claim FROM events),
n AS (SELECT *, row_number() OVER w AS k, last_value(CASE WHEN claim THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
o AS (SELECT *, last_value(CASE WHEN claim THEN event_id END IGNORE NULLS) OVER w AS now_, last_value(CASE WHEN claim THEN coalesce(older, -1) END IGNORE NULLS) OVER w AS old_ FROM n WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
l AS (SELECT user_id AS watch_id, event_id AS seq, "at", k, claim, event_type <> 'error' AS ok, CASE WHEN claim THEN event_id WHEN event_id % 4 = 0 THEN nullif(old_, -1) ELSE now_ END AS token, CASE WHEN NOT claim AND event_id % 5 <> 0 THEN floor(value / 50) END AS value FROM o),
s AS (SELECT watch_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS until_, CAST(0 AS BIGINT) AS due, CAST(0 AS BIGINT) AS version, '' AS outcome FROM l WHERE k = 1
UNION ALL SELECT watch_id, k, CASE outcome WHEN 'GRANTED' THEN token WHEN 'COMMITTED' THEN -1 WHEN 'FAILED' THEN -1 ELSE held END, CASE outcome WHEN 'GRANTED' THEN "at" + {LEASE} WHEN 'COMMITTED' THEN 0 WHEN 'FAILED' THEN 0 ELSE until_ END,
  CASE WHEN outcome IN ('COMMITTED', 'FAILED') THEN "at" + {INTERVAL} ELSE due END, version + CASE outcome WHEN 'COMMITTED' THEN 1 ELSE 0 END, outcome
  FROM (SELECT l.watch_id, l.k, l."at", l.token, s.held, s.until_, s.due, s.version,
    CASE WHEN claim THEN CASE WHEN due > "at" THEN 'NOT_DUE' WHEN until_ > "at" THEN 'LEASED' ELSE 'GRANTED' END WHEN token IS NULL OR held < 0 OR token <> held OR until_ <= "at" THEN 'WATCH_LEASE_LOST' WHEN ok THEN 'COMMITTED' ELSE 'FAILED' END AS outcome
    FROM s JOIN l ON l.watch_id = s.watch_id AND l.k = s.k + 1)),
r AS (SELECT l.watch_id, l.seq, l."at", l.value, s.version, s.outcome FROM l JOIN s ON l.watch_id = s.watch_id AND l.k = s.k) """


@query("watch_outcomes", STEPS + "SELECT watch_id, outcome, count(*) AS n, max(version) AS version FROM r WHERE outcome <> 'GRANTED' GROUP BY 1, 2")
def watch_outcomes(spark, sf_dir):
    """What became of the attempts on each watch, from the published tables."""
    p = _published(spark, sf_dir)
    both = p.read("results").unionByName(p.read("refused"))
    last = F.max("version").alias("version")
    n = both.groupBy("watch_id", "outcome").agg(F.count("*").alias("n"))
    # A refused attempt has no version of its own: that of the last result before it counts.
    w = Window.partitionBy("watch_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("version", F.coalesce(F.last("version", ignorenulls=True).over(w), F.lit(0)))
    return n.join(seen.groupBy("watch_id", "outcome").agg(last), ["watch_id", "outcome"])


@query("watch_versions", STEPS + """, c AS (SELECT *, lag(value) OVER w AS before FROM r WHERE outcome = 'COMMITTED' AND value IS NOT NULL WINDOW w AS (PARTITION BY watch_id ORDER BY "at")),
g AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM value THEN 0 ELSE 1 END) OVER (PARTITION BY watch_id ORDER BY "at") AS run FROM c),
v AS (SELECT watch_id, any_value(value) AS value, min("at") AS valid_at, max("at") AS last_observed_at FROM g GROUP BY watch_id, run)
SELECT watch_id, value, valid_at, lead(valid_at) OVER (PARTITION BY watch_id ORDER BY valid_at) AS invalid_at, last_observed_at FROM v""")
def watch_versions(spark, sf_dir):
    return watches.versions(_published(spark, sf_dir).read("results"))


@query("watch_changes", STEPS + """, c AS (SELECT watch_id, version, "at", value, last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(value) OVER w IS NULL AS across_gap FROM r WHERE outcome = 'COMMITTED' WINDOW w AS (PARTITION BY watch_id ORDER BY version))
SELECT watch_id, version, "at", before, value AS after, across_gap FROM c WHERE before <> value""")
def watch_changes(spark, sf_dir):
    return watches.value_changes(_published(spark, sf_dir).read("results"))


REPORTS = """WITH u AS (SELECT 'r' || (page_id % 3) AS run_id, page_id AS identity, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS origin, CASE WHEN page_id % 5 = 0 THEN 'PENDING' ELSE 'LEASED' END AS state, page_id * 7 AS lease_token, 500 + page_id % 40 AS lease_until FROM pages),
a AS (SELECT u.run_id, u.identity, u.origin, u.state, u.lease_token, u.lease_until, event_id, CASE WHEN event_type = 'error' THEN event_id ELSE u.identity * 7 END AS token, 480 + event_id % 50 AS "at", CASE WHEN event_type = 'signup' THEN 'RETRYABLE' ELSE 'HANDLED' END AS to_state, CASE WHEN event_type = 'signup' THEN 900 + event_id % 60 END AS wait FROM events JOIN u ON u.identity = user_id),
f AS (SELECT *, run_id <> 'r2' AND state = 'LEASED' AND token = lease_token AND lease_until > "at" AS fits FROM a),
t AS (SELECT *, fits AND row_number() OVER (PARTITION BY identity, fits ORDER BY "at", to_state, event_id) = 1 AS taken FROM f) """


def _reports(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.format_string("r%d", F.col("page_id") % 3).alias("run_id"), F.col("page_id").alias("identity"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("origin"), F.when(F.col("page_id") % 5 == 0, "PENDING").otherwise("LEASED").alias("state"))
    urls = p.withColumns({"lease_token": F.col("identity") * 7, "lease_until": 500 + F.col("identity") % 40, "next_at": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "priority": F.lit(1)})
    e = table(spark, sf_dir, "events").join(urls.select("run_id", "identity"), F.col("user_id") == F.col("identity"))
    signup = F.col("event_type") == "signup"
    state = F.when(signup, "RETRYABLE").otherwise("HANDLED")
    attempts = e.select("run_id", "identity", F.when(F.col("event_type") == "error", F.col("event_id")).otherwise(F.col("identity") * 7).alias("token"), (480 + F.col("event_id") % 50).alias("at"), state.alias("state"), (480 + F.col("event_id") % 50).alias("next_at"), F.format_string("%s %012d", state, "event_id").alias("reason"), F.lit(None).cast("int").alias("priority"), F.when(signup, 900 + F.col("event_id") % 60).alias("origin_not_before"))
    origins = urls.where("identity % 4 = 0").select("run_id", "origin", F.lit(930).cast("long").alias("next_at")).distinct()
    return frontier.transition(urls, origins, attempts, spark.createDataFrame([("r2",)], "run_id string"))


@query("fenced_reports", REPORTS + "SELECT run_id, identity, CASE WHEN taken THEN to_state ELSE 'STALE_OR_CANCELLED_LEASE' END AS outcome, count(*) AS n FROM t GROUP BY 1, 2, 3")
def fenced_reports(spark, sf_dir):
    """Reports on leased pages: one of each running lease counts."""
    return _reports(spark, sf_dir)[2].groupBy("run_id", "identity", "outcome").agg(F.count("*").alias("n"))


@query("fenced_urls", REPORTS + """SELECT u.run_id, u.identity, coalesce(t.to_state, u.state) AS state, CASE WHEN t.identity IS NULL THEN u.lease_token END AS lease_token, coalesce(t."at", 0) AS next_at FROM u LEFT JOIN (SELECT * FROM t WHERE taken) t ON t.identity = u.identity""")
def fenced_urls(spark, sf_dir):
    return _reports(spark, sf_dir)[0].select("run_id", "identity", "state", "lease_token", "next_at")


@query("fenced_origins", REPORTS + """SELECT run_id, origin, max(next_at) AS next_at FROM (SELECT DISTINCT run_id, origin, CAST(930 AS BIGINT) AS next_at FROM u WHERE identity % 4 = 0 UNION ALL SELECT run_id, origin, wait FROM t WHERE taken AND wait IS NOT NULL) GROUP BY 1, 2""")
def fenced_origins(spark, sf_dir):
    return _reports(spark, sf_dir)[1]
