"""Streams over the event files, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import events as s

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("stream_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return s.drain(s.tumbling(s.read_events(spark, sf_dir), "1 day"), "update", ["start", "event_type"]).withColumn("total", F.round("total", 4))


@query("stream_sliding", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 21600 * 21600 - o AS start, count(*) AS n FROM events, (VALUES (0), (21600), (43200), (64800)) AS x(o) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return s.drain(s.sliding(s.read_events(spark, sf_dir), "1 day", "6 hours"), "update", ["start"])


@query(
    "stream_session",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM r GROUP BY user_id, k""",
)
def stream_session(spark, sf_dir):
    return s.drain(s.sessions(s.read_events(spark, sf_dir), "2 hours"), "complete")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return s.drain(s.first_of_each(s.read_events(spark, sf_dir), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("stream_changes", "SELECT user_id, event_type, event_id, before, after FROM (SELECT user_id, event_type, event_id, lag(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, CAST(floor(value / 20) AS BIGINT) AS after FROM events) WHERE before <> after")
def stream_changes(spark, sf_dir):
    return s.drain_changes(s.changes(s.read_events(spark, sf_dir), 20.0))


@query("simulation_dispersion")
def simulation_dispersion(spark, sf_dir):
    """A seeded simulation of buyers at two prices; its inputs are parameters, not tables."""
    from tidemark.operators import simulation

    return simulation.dispersion(simulation.run(spark, 7, 40, [800, 1000]), "price", "units")
