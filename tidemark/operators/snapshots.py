"""Trend snapshots whose counts may be capped: intervals for what follows from them, and scores that say what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trend import saturated, score, state

#: Fixed value: what a lower bound of arrivals weighs where counts can't be compared.
ARRIVALS_WEIGHT = 0.2


def counted(posts: DataFrame, key: list[str], seconds: str, platform: str, source: str, step: int, window: int, cap: int | None = None) -> DataFrame:
    """(key, at, n, sources, platforms, fresh, capped) of the captures at each multiple of step that saw a post.

    A capture at `at` sees the posts of (at - window, at]; fresh are those since the capture before. A source that hands out
    `cap` posts at most counts as capped from that number on: n is then a lower bound. Each post goes to the captures that
    see it, window / step of them.
    """
    first = F.ceil(F.col(seconds) / step)
    # The last capture whose window, open at its start, still holds the post.
    last = F.ceil((F.col(seconds) + window) / step) - 1
    seen = posts.where(F.col(seconds).isNotNull()).select(*key, F.col(platform).alias("p_"), F.col(source).alias("s_"), first.alias("first_"), F.explode(F.sequence(first, F.greatest(first, last))).alias("k_"))
    g = seen.groupBy(*key, (F.col("k_") * step).alias("at"), "s_", "p_").agg(F.count("*").alias("c_"), F.sum((F.col("k_") == F.col("first_")).cast("long")).alias("f_"))
    by_source = g.groupBy(*key, "at", "s_").agg(F.sum("c_").alias("c_"), F.sum("f_").alias("f_"), F.collect_set("p_").alias("p_"))
    sums = by_source.groupBy(*key, "at").agg(F.sum("c_").alias("all_"), F.count("*").alias("sources"), F.sum("f_").alias("fresh"))
    wide = g.groupBy(*key, "at", "p_").agg(F.count("*").alias("c_")).groupBy(*key, "at").agg(F.count("p_").alias("platforms"))
    capped = F.lit(False) if cap is None else F.col("all_") >= cap
    n = F.col("all_") if cap is None else F.least(F.col("all_"), F.lit(cap).cast("long"))
    return sums.join(wide, [*key, "at"]).select(*key, "at", n.alias("n"), "sources", "platforms", "fresh", capped.alias("capped"))


def scored(captures: DataFrame, key: list[str]) -> DataFrame:
    """captures (key, at, n, sources, platforms, fresh, capped) with velocity_low and velocity_high (per hour; null where
    unbounded), velocity and acceleration (where the counts are exact), persistence, score, coverage, state and left_out.

    Of a capped count only the lower bound is known, so a difference of two counts is an interval: from a capped one to an
    exact one it has no lower end, from an exact to a capped one no upper end. Velocity and acceleration leave the score
    where a count that they need is capped; the arrivals since the capture before, a lower bound, take their place.
    """
    w = Window.partitionBy(*key).orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    hours = (F.col("at") - F.lag("at").over(w)) / 3600
    was, was_capped = F.lag("n").over(w), F.lag("capped").over(w)
    change = (F.col("n") - was) / hours
    c = captures.withColumns({"hours_": hours, "velocity_low": F.when(~was_capped, change), "velocity_high": F.when(~F.col("capped"), change), "persistence": F.avg((F.col("n") > 0).cast("int")).over(before), "first_": was.isNull(), "inexact_": F.col("capped") | F.coalesce(was_capped, F.lit(False))})
    c = c.withColumn("velocity", F.when(~F.col("inexact_"), F.col("velocity_low")))
    c = c.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / F.col("hours_"))
    excluded = ~F.col("first_") & F.col("inexact_")
    known = lambda v, part: F.when(v.isNotNull(), part)
    parts: dict[str, Column] = {
        "velocity": known(F.col("velocity"), saturated(F.col("velocity"))),
        "acceleration": known(F.col("acceleration"), saturated(F.col("acceleration"))),
        "persistence": F.col("persistence"),
        "source_diversity": F.col("sources") / (F.col("sources") + 1),
        "platform_diversity": F.col("platforms") / (F.col("platforms") + 1),
        "novelty": F.when(~F.col("first_"), F.least(F.col("fresh"), F.col("n")) / F.greatest(F.col("n"), F.lit(1))),
        "cross_platform_recurrence": F.when(F.col("platforms") > 1, 1.0).otherwise(0.0),
    }
    total, coverage = score(parts)
    arrivals = saturated(F.col("fresh") / F.col("hours_"))
    total = total + F.when(excluded, ARRIVALS_WEIGHT * arrivals).otherwise(0.0)
    coverage = coverage + F.when(excluded, ARRIVALS_WEIGHT).otherwise(0.0)
    label = state(F.col("n"), F.col("velocity"), F.col("acceleration"), F.col("persistence"))
    gone = F.array_compact(F.array(F.when(excluded, "velocity"), F.when(F.col("acceleration").isNull() & excluded, "acceleration")))
    out = ["at", "n", "sources", "platforms", "fresh", "capped", "velocity_low", "velocity_high", "velocity", "acceleration", "persistence"]
    return c.select(*key, *out, total.alias("score"), coverage.alias("coverage"), label.alias("state"), gone.alias("left_out"))
