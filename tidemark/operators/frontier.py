"""A crawl frontier as frames: which URL is leased next, what a failure costs, what is reclaimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reclaimed(urls: DataFrame, now: Column, max_retries: int) -> DataFrame:
    """Leases that ran out go back, or fail when they were tried too often."""
    out = (F.col("state") == "LEASED") & (F.col("lease_until") <= now)
    state = F.when(out & (F.col("attempts") > max_retries), "FAILED").when(out, "RETRYABLE").otherwise(F.col("state"))
    return urls.withColumns({"state": state, "lease_until": F.when(~F.coalesce(out, F.lit(False)), F.col("lease_until"))})


def next_leases(urls: DataFrame, origins: DataFrame, now: Column, per_origin: int, total: int) -> DataFrame:
    """The URLs to lease: ready, their origin not cooling down, under its and the overall limit; by priority.

    One per origin and free place; leases are counted once per origin and joined.
    """
    leased = urls.where("state = 'LEASED'").groupBy("origin").agg(F.count("*").alias("busy"))
    free = total - (urls.where("state = 'LEASED'").count())
    ready = urls.where(F.col("state").isin("QUEUED", "RETRYABLE") & (F.col("next_at") <= now))
    j = ready.join(leased, "origin", "left").join(origins.select("origin", F.col("next_at").alias("cool")), "origin", "left")
    j = j.where((F.coalesce("busy", F.lit(0)) < per_origin) & F.coalesce(F.col("cool") <= now, F.lit(True)))
    order = [F.desc("priority"), F.asc("next_at"), F.asc("discovered_at"), F.asc("url_id")]
    k = F.row_number().over(Window.partitionBy("origin").orderBy(*order))
    j = j.withColumn("k_", k).where(F.col("k_") <= per_origin - F.coalesce("busy", F.lit(0)))
    return j.orderBy(*order).limit(max(0, free)).select(urls.columns)


def backoff(attempts: Column, base: int, most: int, retry_after: Column) -> Column:
    """Seconds until the next try: doubled each time up to a limit, and no less than the server asked for."""
    doubled = F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most)))
    return F.greatest(doubled, F.coalesce(retry_after.cast("double"), F.lit(0.0))).cast("long")


def enqueue(urls: DataFrame, found: DataFrame, max_depth: int, max_bytes: int = 8192) -> DataFrame:
    """Found URLs that aren't known yet, by identity; of equal ones the one found first."""
    fit = found.where((F.col("depth") <= max_depth) & (F.octet_length("url") <= max_bytes))
    one = fit.groupBy("run_id", "identity").agg(F.min_by(F.struct("url", "origin", "depth", "discovered_at"), F.struct("discovered_at", "url")).alias("u"))
    return one.select("run_id", "identity", "u.*").join(urls.select("run_id", "identity"), ["run_id", "identity"], "left_anti")


def transition(urls: DataFrame, origins: DataFrame, attempts: DataFrame, cancelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(urls, origins, verdicts) after workers' reports (run_id, identity, token, at, state, next_at, reason, priority,
    origin_not_before).

    A report counts if its URL is leased under its token and the lease still runs, and the run isn't among `cancelled`
    (run_id). Of several such reports of a lease the first one counts, for a lease ends with it. Others are refused as
    STALE_OR_CANCELLED_LEASE and change nothing, the origin's next time included. A priority that isn't given stays.
    """
    key = ["run_id", "identity"]
    held = urls.where("state = 'LEASED'").select(*key, "origin", F.col("lease_token").alias("held_"), F.col("lease_until").alias("until_"))
    numbered = attempts.withColumn("n_", F.monotonically_increasing_id())
    stopped = cancelled.select("run_id", F.lit(True).alias("stopped_")).distinct()
    j = numbered.join(held, key, "left").join(stopped, "run_id", "left")
    fits = F.coalesce((F.col("token") == F.col("held_")) & (F.col("until_") > F.col("at")) & F.col("stopped_").isNull(), F.lit(False))
    # One row for each lease: a repeated report is one more row of few.
    order = F.row_number().over(Window.partitionBy(*key, "fits_").orderBy("at", "reason", "n_"))
    j = j.withColumn("fits_", fits).withColumn("taken_", F.col("fits_") & (order == 1))
    verdicts = j.select(*key, "token", "at", "state", "reason", F.when(F.col("taken_"), F.col("state")).otherwise("STALE_OR_CANCELLED_LEASE").alias("outcome"))
    new = j.where("taken_").select(*key, F.col("state").alias("s_"), F.col("next_at").alias("t_"), F.col("reason").alias("r_"), F.col("priority").alias("p_"))
    done = F.col("s_").isNotNull()
    fresh = {
        "state": F.coalesce("s_", "state"),
        "next_at": F.when(done, F.col("t_")).otherwise(F.col("next_at")),
        "last_error": F.when(done, F.col("r_")).otherwise(F.col("last_error")),
        "priority": F.coalesce("p_", "priority"),
        "lease_token": F.when(~done, F.col("lease_token")),
        "lease_until": F.when(~done, F.col("lease_until")),
    }
    after = urls.join(new, key, "left").select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in urls.columns])
    waits = j.where("taken_ AND origin_not_before IS NOT NULL").select("run_id", "origin", F.col("origin_not_before").alias("next_at"))
    later = origins.select("run_id", "origin", "next_at").unionByName(waits).groupBy("run_id", "origin").agg(F.max("next_at").alias("next_at"))
    return after, later, verdicts


def cancel(urls: DataFrame, runs: DataFrame) -> DataFrame:
    """urls with what isn't done of the runs (run_id) cancelled, leases included."""
    j = urls.join(runs.select("run_id", F.lit(True).alias("stop_")).distinct(), "run_id", "left")
    open_ = F.col("stop_").isNotNull() & F.col("state").isin("DISCOVERED", "PENDING", "QUEUED", "LEASED", "RETRYABLE")
    fresh = {"state": F.when(open_, "CANCELLED").otherwise(F.col("state")), **{c: F.when(~open_, F.col(c)) for c in ("lease_token", "lease_until")}}
    return j.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in urls.columns])
